"""Scalar rules of the graph domain as Column functions: paths, channels, identifiers, names."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for "no channel".
SENTINELS = ("", "unknown", "unknown-event")
#: Entry kinds whose channel is a broker destination, for the queries; the linker also counts websocket.
MESSAGE_CONSUMERS = (
    "kafka-consumer", "rabbitmq-consumer", "jms-consumer", "sqs-consumer", "pulsar-consumer", "mqtt-consumer", "event-listener", "message-handler", "reactive-incoming",
)
LINKED_CONSUMERS = (*MESSAGE_CONSUMERS, "websocket")
#: Calls that say nothing about the execution path.
TRIVIAL_CALLS = (
    "println", "printf", "print", "toString", "hashCode", "equals", "getClass", "valueOf", "format", "stream", "collect", "toList", "map", "filter",
    "forEach", "size", "isEmpty", "contains", "indexOf", "add", "remove", "clear", "put", "get", "next", "hasNext", "iterator", "of", "from",
    "copyOf", "range", "between", "assertNull", "assertNotNull", "assertThat", "assertEquals", "debug", "info", "warn", "error", "trace",
    "findFirst", "findAny", "orElse", "orElseThrow", "builder", "build", "create", "newInstance", "values", "keySet", "entrySet", "asList",
    "singletonList", "emptyList", "isPresent", "close", "flush", "shutdown", "stop",
)
TRIVIAL_DEFINITIONS = ("toString", "hashCode", "equals", "getClass")
HTTP_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH")
TITLE_CHARS = 60


#: White space as strip() takes it: ASCII's, the separators 1C to 1F, next line, and all of Unicode's separators.
WHITE_SPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.trim(x, F.lit(WHITE_SPACE))


def last_seg(x: Column) -> Column:
    return F.substring_index(x, ".", -1)


def repo_of(x: Column) -> Column:
    """Text before the first colon; all of it if there is none; `unknown` if blank."""
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("unknown")).otherwise(F.substring_index(x, ":", 1))


def has_channel(x: Column) -> Column:
    """Whether a channel, already trimmed where trimming is wanted, names something."""
    return ~F.coalesce(x, F.lit("")).isin(*SENTINELS)


def normalize_http_path(path: Column) -> Column:
    """Template, numeric and UUID-like segments become {p}; blank segments go."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    braces = lambda s: s.contains("{") | s.contains("}")
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s: F.when(braces(s) | s.rlike("^[0-9]+$") | ((F.length(s) == 36) & s.contains("-")), "{p}").otherwise(s)), "/"))


def strip_http_origin(url: Column) -> Column:
    """Path of an http or https URL, / if it has none; other text as it is."""
    rest = F.regexp_replace(url, "^https?://[^/]*", "")
    return F.when(url.rlike("^https?://"), F.when(rest == "", F.lit("/")).otherwise(rest)).otherwise(url)


def join_rest_path(prefix: Column, path: Column) -> Column:
    """A class-level prefix and a method-level path; an unknown path leaves the prefix."""
    return F.when(path == "unknown", prefix).when(path.startswith("/"), F.concat(prefix, path)).otherwise(F.concat(prefix, F.lit("/"), path))


def channel_verb(channel: Column) -> Column:
    """The HTTP verb that a channel's text begins with, or nothing."""
    out = F.lit("")
    for verb in reversed(HTTP_VERBS):
        out = F.when(F.upper(channel).startswith(verb), F.lit(verb)).otherwise(out)
    return out


def slugify(name: Column, fallback: str = "project") -> Column:
    """Runs of other characters than letters and digits become a dash; lower case; a fallback if nothing is left."""
    dashed = F.lower(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(F.coalesce(dashed, F.lit("")) == "", F.lit(fallback)).otherwise(dashed)


def repo_name_from_url(url: Column) -> Column:
    """The last path segment without .git; `repo` if nothing is left."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), "\\.git$", ""), "/"), -1)
    return F.when(last == "", F.lit("repo")).otherwise(last)


def sqs_queue_name(token: Column) -> Column:
    """Queue of an ARN (after the last colon) or of a URL (last segment); other text as it is."""
    return F.when(token.startswith("arn:"), F.substring_index(token, ":", -1)).when(token.startswith("http"), F.substring_index(F.regexp_replace(token, "/+$", ""), "/", -1)).otherwise(token)


def is_urlish(token: Column) -> Column:
    return token.startswith("/") | token.startswith("http") | token.contains("${") | token.contains("#{")


def is_test_path(path: Column) -> Column:
    """Under a test folder, or a file whose stem ends in Test, Tests or IT (case counts)."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")
    return path.contains("/src/test/") | path.contains("/test/") | stem.rlike("(Test|Tests|IT)$")


def is_test_of(path: Column, folders: tuple[str, ...] = (), names: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> Column:
    """A test by a language's own rules: a part of the path (folders) or a whole segment (names), both whatever the case of the path, or the end of the file's stem (suffixes, case counts)."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?<=.)\\.[^.]*$", "")
    tests = [F.contains(low, F.lit(f.replace("\\", "/"))) for f in folders] + [F.endswith(stem, F.lit(s)) for s in suffixes]
    return reduce(or_, tests, F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(n) for n in names])) if names else F.lit(False))


def is_pruned_path(path: Column) -> Column:
    """Inside a build or tool folder; under target only generated sources are kept."""
    inside = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.concat(F.lit("/"), inside, F.lit("/")).rlike("/(node_modules|build|dist|bin|\\.git|\\.gradle)/|/target/(?!generated-sources/)")


def is_trivial_call(display: Column, arity: Column) -> Column:
    """A call that says nothing: a listed name, or an accessor without arguments."""
    last = last_seg(display)
    return last.isin(*TRIVIAL_CALLS) | ((arity == 0) & last.rlike("^(get|set|has).+|^is.+"))


def is_trivial_definition(name: Column) -> Column:
    return name.isin(*TRIVIAL_DEFINITIONS) | name.rlike("^(get|set).+|^is.+")


def title_case(name: Column) -> Column:
    """camelCase as words with a capital first letter."""
    spaced = F.regexp_replace(name, "([A-Z])", " $1")
    return F.trim(F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30)))


def auto_title(text: Column) -> Column:
    """White space collapsed; over 60 characters cut and marked by an ellipsis."""
    plain = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(plain) > TITLE_CHARS, F.concat(F.substring(plain, 1, TITLE_CHARS), F.lit("…"))).otherwise(plain)


def compact_text(text: Column, most: int = 800, keep: int = 300) -> Column:
    """A long text's head and tail around a marker with the number of characters left out."""
    left = (F.length(text) - 2 * keep).cast("string")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("\n…["), left, F.lit(" chars omitted]…\n"), F.substring(text, -keep, keep))).otherwise(text)


def occurrences(text: Column, find: Column) -> Column:
    return F.when(F.length(find) > 0, ((F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.length(find)).cast("int")).otherwise(0)


def parse_host_link(url: Column) -> Column:
    """struct(provider, owner, project) of a link to an account or project page; null fields where it is none.

    Empty and dotted segments are rejected, and so are more segments than a provider has.
    """
    name = "^[A-Za-z0-9][A-Za-z0-9-]*$"
    clean = F.trim(url)
    bare = F.regexp_replace(clean, "^https?://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, "^[^/?#]*", 0), ":[0-9]*$", ""))
    path = F.regexp_extract(bare, "^[^/?#]*([^?#]*)", 1)
    odd = ~clean.rlike("^https?://") | (host == "") | path.contains("//") | path.contains("/./") | path.contains("/../")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.size(parts)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    studio = host.endswith(".visualstudio.com")
    whole = F.array_join(parts, "/")
    provider = (
        F.when(host.isin("github.com", "www.github.com") & (n == 1) & first.rlike(name), "github")
        .when(host.isin("gitlab.com", "www.gitlab.com") & (n >= 1) & whole.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*(/[A-Za-z0-9][A-Za-z0-9._-]*)*$"), "gitlab")
        .when(host.isin("bitbucket.org", "www.bitbucket.org") & (n == 1) & first.rlike(name), "bitbucket")
        .when(studio & (n <= 1) | (host == "dev.azure.com") & (n >= 1) & (n <= 2) & first.rlike(name), "azure-devops")
    )
    provider = F.when(~odd, provider)
    owner = F.when(provider == "gitlab", whole).when(studio, F.regexp_replace(host, "\\.visualstudio\\.com$", "")).otherwise(first)
    project = F.when(studio, first).otherwise(second)
    return F.struct(provider.alias("provider"), F.when(provider.isNotNull(), owner).alias("owner"), F.when(provider == "azure-devops", project).alias("project"))

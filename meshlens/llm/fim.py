"""Fill-in-the-middle examples, cut between the units of a text by joins of unit rows.

A text is exploded into its units (lines by default) by posexplode(); a window's running sum of their
lengths gives each unit's end in code points.  Two cuts a document, drawn from the hash of its id, ask
for ends by unit ordinal: requests are joined with units, the ends found are aggregated a document, and
substring() takes the parts.  No text leaves the JVM and no unit's text is shuffled: documents are dealt
once by a key of their own, and explosion, window, join, aggregation and substring() all keep that deal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A line with its end, or what stands after the last.
LINES = r"[^\n]*\n|[^\n]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    """Marks of the parts.  None may overlap with another's or its own end, so that the first one found in an output is the one that was put there."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("sentinels are three different strings")
        for x in marks:
            for y in marks:
                if x != y and y in x or any(y.startswith(x[k:]) for k in range(1, len(x))):
                    raise ValueError(f"{x!r} and {y!r} overlap")

    def within(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.prefix)) | F.contains(text, F.lit(self.suffix)) | F.contains(text, F.lit(self.middle))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 of an id: the first groups of eight digits of the SHA-256 of `seed:id`; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, marks: Sentinels = Sentinels()) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of docs (doc_id, text), a row each.

    n counts the units of a text; the prefix ends after the lesser of two drawn numbers of units, the
    middle after the greater, both from 0 to n.  `rate` in a hundred texts are cut, `spm` in a hundred of
    those as suffix, prefix, middle, the others as prefix, suffix, middle.  Plain are empty and null texts
    (null counts as empty), those that hold a sentinel and those not drawn; their lengths are null.  Rows that
    repeat are rows of their own, equal ids draw equal numbers, and an empty table gives an empty one.
    Other columns of docs are not read.  `unit` has to match every character once, as LINES does.
    docs should be a table or a checkpoint: rows are told apart by their place in it.
    """
    row = F.struct(F.monotonically_increasing_id().alias("at"), F.col("doc_id").alias("doc_id")).alias("row")
    dealt = docs.select(row, F.coalesce(F.col("text"), F.lit("")).alias("text")).repartition("row")
    pieces = dealt.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(unit), F.lit(0))).alias("at", "unit"))
    so_far = Window.partitionBy("row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = pieces.select("row", (F.col("at") + 1).alias("ordinal"), F.char_length("unit").cast("bigint").alias("chars")).withColumn("end", F.sum("chars").over(so_far))

    n = F.regexp_count("text", F.lit(unit)).cast("bigint")
    h1, h2, h3, h4 = draws(F.col("row.doc_id"), seed)
    plain = (F.length("text") == 0) | marks.within(F.col("text")) | (h3 % 100 >= rate)
    asked = dealt.select(
        "row", "text", n.alias("n"),
        F.when(plain, PLAIN).when(h4 % 100 < spm, SPM).otherwise(PSM).alias("form"),
        F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("first"), F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("second"),
    )
    requests = asked.select(F.col("row").alias("_row"), "first", "second")  # of plain texts too: a filter would go below the deal, which is then done twice
    met = ends.join(requests, (F.col("row") == F.col("_row")) & ((F.col("ordinal") == F.col("first")) | (F.col("ordinal") == F.col("second"))))
    offsets = met.groupBy(F.col("row").alias("_row")).agg(
        F.max(F.when(F.col("ordinal") == F.col("first"), F.col("end"))).alias("_first"), F.max(F.when(F.col("ordinal") == F.col("second"), F.col("end"))).alias("_second")
    )
    cut = F.col("form") != PLAIN
    first, second = F.coalesce("_first", F.lit(0)), F.coalesce("_second", F.lit(0))  # a cut after no unit meets none
    placed = asked.join(offsets, F.col("row") == F.col("_row"), "left").select(
        F.col("row.doc_id").alias("doc_id"), "text", "n", "form",
        F.when(cut, first).alias("prefix_chars"), F.when(cut, second - first).alias("middle_chars"),
    )
    prefix = F.substring("text", F.lit(1), F.col("prefix_chars").cast("int"))
    middle = F.substring("text", (F.col("prefix_chars") + 1).cast("int"), F.col("middle_chars").cast("int"))
    suffix = F.substring("text", (F.col("prefix_chars") + F.col("middle_chars") + 1).cast("int"), F.char_length("text"))
    p, s, m = F.lit(marks.prefix), F.lit(marks.suffix), F.lit(marks.middle)
    output = F.when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == SPM, F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    return placed.withColumn("output", output)


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that an output of fill_in_middle() was made of."""

    def between(start: Column, end: Column) -> Column:
        return F.substring(output, start, end - start)

    p, s, m = (F.locate(x, output) for x in (marks.prefix, marks.suffix, marks.middle))
    at = {name: len(x) for name, x in (("p", marks.prefix), ("s", marks.suffix), ("m", marks.middle))}
    middle = F.substring(output, m + at["m"], F.char_length(output))
    of_psm = F.concat(between(F.lit(at["p"] + 1), s), middle, between(s + at["s"], m))
    of_spm = F.concat(between(p + at["p"], m), middle, between(F.lit(at["s"] + 1), p))
    return F.when(form == PSM, of_psm).when(form == SPM, of_spm).otherwise(output)


def fim_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): what fill_in_middle() makes of lines, and its reversal."""
    made = fill_in_middle(docs)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


#: The same rows in DuckDB: the unit lists whole, parts by joining them.
DIGEST_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), h AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

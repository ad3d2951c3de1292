"""Token counts of whole texts; huge texts by overlapping chunks that are spliced at stable boundaries."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, resolve

#: Characters of a chunk, and of the overlap of two chunks at first.
CHUNK = 16_384
OVERLAP = 512
LIMIT = 4096

MARK = "▁"


def inner_pairs(pieces: list[str]) -> frozenset[str]:
    """The pairs of neighbouring characters within pieces, spaces as the space mark.

    Every token, and every merge on the way to it, is a piece.  So none ever reaches across a place
    whose two characters aren't such a pair: what stands before it is encoded as if it stood alone,
    and so is what stands after it, in any script and with or without spaces.
    """
    return frozenset(p[k : k + 2] for p in pieces for k in range(len(p) - 1))


def spliced_count(text: str, encode: Callable[[str], list[tuple[int, int]]], pairs: frozenset[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, where encode(part) gives the (begin, end) character offsets of a part's tokens.

    Each chunk is encoded with offsets.  Two neighbours are spliced at a position in their overlap
    that is a proven stable boundary (its characters aren't in pairs, see inner_pairs()) and where a
    token starts in both.  If there is none, the overlap is widened, in the end over the whole rest,
    so the count is always that of the whole text.
    """

    def stable(begin: int, end: int):
        return (k for k in range(begin, end) if text[k - 1 : k + 1].replace(" ", MARK) not in pairs)

    size = len(text)
    start, begin_at, total = 0, 0, 0  # tokens of the chunk at start count from begin_at on
    stop = min(size, chunk)
    spans = [a + start for a, _ in encode(text[start:stop])]
    while stop < size:
        wide, splice, mine = overlap, None, set(spans)
        next_stop = min(size, stop + chunk)
        while splice is None:
            next_start = max(begin_at, stop - wide)
            if any(k in mine for k in stable(next_start + 1, stop)):  # else nothing in this overlap can be spliced, whatever the next chunk gives
                after = [a + next_start for a, _ in encode(text[next_start:next_stop])]
                both = mine & set(after)
                splice = next((k for k in stable(next_start + 1, stop) if k in both), None)
            if next_start == begin_at:
                break
            wide *= 4
        if splice is None:  # nothing to splice at: this chunk grows instead
            stop = min(size, stop + max(chunk, stop - start))
            spans = [a + start for a, _ in encode(text[start:stop])]
            continue
        total += sum(begin_at <= a < splice for a in spans)
        start, begin_at, stop, spans = next_start, splice, next_stop, after
    return total + sum(a >= begin_at for a in spans) if begin_at else total + len(spans)


class Counter:
    """Counts of a .model (sentencepiece) or .json (tokenizers) vocabulary, without added special tokens."""

    def __init__(self, path: str) -> None:
        path = resolve(path)
        self.piecewise = path.endswith(".model")
        if self.piecewise:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
            probe = "a  éé ﬁ　b\t c "
            self.pairs = inner_pairs(pieces)
            self.splices = self.model.normalize(probe).removeprefix(MARK) == probe.replace(" ", MARK)  # a normaliser that rewrites texts has contexts of its own: such texts are encoded whole
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.splices = False  # other vocabularies are encoded whole

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return self.model.encode(text, return_type="offset_mapping")["offsets"]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.piecewise:
            return [len(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        huge = {i for i, t in enumerate(texts) if len(t) > CHUNK} if self.splices else set()
        plain = [t for i, t in enumerate(texts) if i not in huge]
        got = iter([len(x) for x in self.model.encode(plain, num_threads=1)] if plain else [])
        return [spliced_count(t, self.offsets, self.pairs) if i in huge else next(got) for i, t in enumerate(texts)]


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null text counts as empty: 0 bytes, 0 tokens.  Equal texts get equal counts; rows that repeat
    stay.  Other columns are dropped; an empty table gives an empty one.  Texts over CHUNK characters
    are counted by splicing.
    """

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = Counter(tokenizer)

        def f(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = count(texts)
            return {id_col: batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return f

    return arrow_map(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), make, f"{id_col} bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", text_col=1)

"""Language identification by compression.

For each language, texts of a labelled sample make a raw-content Zstandard dictionary. A text is compressed with every
dictionary, in pieces so that a long text leans on the dictionary to its end, and the language with the smallest sum
wins. The fewer bytes it saves over the second, the less certain the answer: below `margin` (a share of the second's
size) the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.sample import labelled
from alphaloom.llm.shared import with_columns_of

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Bytes of a piece, bytes of a lead text of a full sample, and lead texts of a language.
PIECE, LEAD, LEADS = 8192, 6144, 2
Model = tuple[tuple[str, bytes], ...]


def fit(docs: DataFrame, labels: DataFrame, texts_per_language: int = 160, dictionary_bytes: int = (1 << 17) + LEADS * LEAD) -> Model:
    """A dictionary for each language, from at most texts_per_language texts; labels: id, label (the language).

    All sampled texts of a language have a share in its dictionary_bytes: short ones whole, the others the same number of
    bytes from their start each. Rows without a text or a label are not sampled, and an id that repeats counts once. A
    table without labels, or an empty one, gives a model without languages.
    """
    parts: dict[str, list[bytes]] = {}
    for lang, text in labelled(docs, labels, texts_per_language):
        parts.setdefault(str(lang), []).append(text.lower().encode())
    return tuple((lang, b"\n".join(shares(p, dictionary_bytes))) for lang, p in sorted(parts.items()))


def shares(texts: list[bytes], total: int) -> list[bytes]:
    """The texts cut to one length, the longest with which they and the signs between them stay within total bytes."""
    left, length = total - len(texts) + 1, 0
    for k, n in enumerate(sorted(map(len, texts))):
        length = max(0, left) // (len(texts) - k)
        if n > length:
            break
        length, left = n, left - n
    return [t[:length] for t in texts]


@lru_cache(maxsize=4)
def _compressors(model: Model) -> list[tuple[zstandard.ZstdCompressor, list[tuple[bytes, int]]]]:
    """For each language a compressor with its dictionary, and LEADS lead texts of it with their compressed sizes.

    Sizes are summed over the lead texts, so every language has as many; a small sample gives half its bytes to them and
    half to the dictionary.
    """
    out = []
    for _, content in model:
        lead = min(LEAD, len(content) // (2 * LEADS))
        cut = len(content) - LEADS * lead
        content, rest = content[:cut], content[cut:]
        params = zstandard.ZstdCompressionParameters.from_level(3, dict_size=len(content), source_size=LEAD + PIECE, min_match=4, write_content_size=0)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        c = zstandard.ZstdCompressor(compression_params=params, dict_data=d)
        leads = [rest[i * lead : (i + 1) * lead] for i in range(LEADS)]
        out.append((c, [(x, len(c.compress(x))) for x in leads]))
    return out


def sizes(text: str, model: Model) -> list[int]:
    """Compressed bytes of the lower-cased text for each language.

    Each piece follows a lead text of the language, whose own size is taken off: few bytes earn no entropy table of
    their own, and would count alike for every language. Pieces follow the lead texts in turn, and a text of fewer
    pieces than there are leads begins again, so that every text meets every lead.
    """
    data = text.lower().encode()
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    times = range(len(pieces) * -(-LEADS // len(pieces)))
    out = []
    for c, leads in _compressors(model):
        pairs = ((leads[i % LEADS], pieces[i % len(pieces)]) for i in times)
        out.append(sum(len(c.compress(x + p)) - k for (x, k), p in pairs))
    return out


def judge(text: str | None, model: Model, margin: float) -> tuple[str, float, float, bool]:
    """Language, score, margin (share of the second's bytes saved) and whether the answer is accepted."""
    if text is None or not model or not LETTER.search(text):
        return UNKNOWN, 0.0, 0.0, False
    found = sizes(text, model)
    order = np.argsort(found, kind="stable")
    best, second = found[order[0]], found[order[1]] if len(found) > 1 else found[order[0]]
    share = (second - best) / max(1, second) if len(found) > 1 else 1.0
    # Each byte saved counts as two bits of evidence, an eighth of what an ideal coder would grant.
    score = 1.0 / sum(2.0 ** max(-60.0, 2.0 * (best - s)) for s in found)
    return model[order[0]][0], score, share, share >= margin


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", margin: float = 0.004) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), margin, accepted: a row for each row of docs.

    A null text, an empty one and one without a letter give `und`, score 0, not accepted; so does any text when the
    sample held no language. Of equally small sizes the alphabetically first language wins, and is not accepted. Ids may
    be null or repeat, and are passed on. Whole texts are read; no other column is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t.as_py(), model, margin) for t in b.column(1)]
            lang, score, share, ok = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64()), pa.array(ok, pa.bool_())], names=[doc_id, "lang_pred", "score", "margin", "accepted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, f"`{doc_id}` {kind}, lang_pred string, score double, margin double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model, text: str = "text", margin: float = 0.004) -> DataFrame:
    """The rows of docs whose language is accepted, with their columns and no shuffle.

    A null or empty text, one without a letter and one between two languages goes, whatever its id; repeated rows have
    one fate. An empty table gives no rows, and so does a sample that held no language.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([judge(t.as_py(), model, margin)[3] for t in b.column(at)], pa.bool_()))

    return with_columns_of(docs.mapInArrow(run, docs.schema), docs.columns)

"""Language identification by compression.

Each language has a raw-content zstandard dictionary: a bounded amount of its learned
text. A document is compressed once with each dictionary; the smallest result names
its language. Texts are compressed in segments, so the dictionary serves a long text
to its end and memory stays bounded. Where the two smallest results are too close the
row is marked as rejected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annoweave.llm.base import id_bucket, in_small_batches, sliced

FOLDS = 5
#: A dictionary holds so many pieces of so many characters at most, each from another row.
PIECES, PIECE = 110, 1024
#: Bytes of all dictionaries together, at most.
ALL_BYTES = 64 << 20
SEGMENT = 1024
#: How thoroughly zstandard looks for matches.
STRATEGY = zstandard.STRATEGY_BTLAZY2
#: Relative difference of the two smallest sizes under which a prediction is rejected.
MARGIN = 0.01
UNDETERMINED = "und"
NO_LETTER = 0.0

_LETTER = regex.compile(r"\p{L}")
_OUT = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()),
])


def learn_dictionaries(docs: DataFrame, folds: int = FOLDS, pieces: int = PIECES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, the commonest language first, ties in order of name.

    Learned from rows with text and language whose crc32(id) mod folds is not 0: of
    `pieces` rows a language, chosen by hash, one piece each, from a place that a hash
    chooses in the whole text. All dictionaries together have ALL_BYTES at most; so many
    languages that none of them would get a piece are an error.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter(
        F.col("l").isNotNull() & (F.length("t") > 0) & F.col("id").isNotNull() & (id_bucket(folds, "id") != 0)
    )
    by_size = usable.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    most = ALL_BYTES // (4 * PIECE)  # a character has four bytes at most
    counts = {r[0]: r[1] for r in by_size.limit(most + 1).collect()}
    if not counts:
        return {}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    pieces = max(1, min(pieces, most // len(counts)))
    # one scan: a row is taken if its hash is below 2 * pieces / (rows of its language), so enough rows are, but for very bad luck
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, (2 * pieces + 40) / n))])
    u = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(9)), 11) / F.lit(float(1 << 53))
    start = F.pmod(F.xxhash64("id", F.lit(10)), F.greatest(F.length("t") - PIECE, F.lit(0)) + 1)
    taken = usable.withColumn("u", u).filter(F.col("u") < share[F.col("l")]).select("l", "u", "id", F.substring("t", (start + 1).cast("int"), F.lit(PIECE)).alias("piece"))
    nth = F.row_number().over(Window.partitionBy("l").orderBy("u", "id", "piece"))
    chosen = taken.withColumn("nth", nth).filter(F.col("nth") <= pieces)
    by: dict[str, list] = {}
    for lang, at, text in chosen.select("l", "nth", "piece").collect():  # ALL_BYTES at most
        by.setdefault(lang, []).append((at, normal(text).encode("utf-8", "surrogatepass")))
    return {lang: b"\n".join(x for _, x in sorted(by[lang])) for lang in sorted(by, key=lambda k: (-counts[k], k))}


def normal(text: str) -> str:
    return " ".join(text.lower().split())


class Compressors:
    """One compressor for each language, alike for all texts."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)
        self.compress = [self._compressor(raw) for raw in dictionaries.values()]

    @staticmethod
    def _compressor(raw: bytes) -> Callable[[bytes], bytes]:
        params = zstandard.ZstdCompressionParameters.from_level(
            3, min_match=3, strategy=STRATEGY, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). Sizes that tie go to the commoner language."""
        if text is None or not self.langs or not _LETTER.search(text):
            return UNDETERMINED, NO_LETTER, True
        raw = normal(text).encode("utf-8", "surrogatepass")
        sizes = [0] * len(self.langs)
        for at in range(0, len(raw), SEGMENT):
            part = raw[at : at + SEGMENT]
            for i, f in enumerate(self.compress):
                sizes[i] += len(f(part))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(rest) - sizes[best]) / max(1, min(rest)) if rest else 1.0
        return self.langs[best], 1 - 0.5 * math.exp(-margin * 20), margin < MARGIN


def identify(docs: DataFrame, folds: int = FOLDS, dictionaries: dict[str, bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of each row's whole text.

    lang_pred is 'und' with score 0 if the text is null, has no letter or nothing was
    learned; otherwise a learned language, also where `rejected` says that the margin
    is narrow; equal sizes go to the commoner language, then to the first by name. A
    letter is what Unicode calls one: figures in other forms are none. Rows with a null id
    are predicted and never learned from; repeated rows stay repeated. Long texts are
    compressed to their end, a segment at a time. An empty table gives no rows; other
    columns are ignored.

    Returns doc_id, held_out, lang_pred, score, rejected.
    """
    known = docs.sparkSession.sparkContext.broadcast(learn_dictionaries(docs, folds, id_col=id_col) if dictionaries is None else dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Compressors(known.value)
        for b in sliced(batches):
            rows = [found.predict(t) for t in b.column(2).to_pylist()]
            cols = [pa.array([r[i] for r in rows], _OUT.types[2 + i]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *cols], schema=_OUT)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_bucket(folds, id_col) == 0).alias("held_out"), F.col(text_col).alias("t"))
    return in_small_batches(plain).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")

"""Quality scores by compression: zstandard dictionaries of good and of bad text.

Two raw-content dictionaries of equal size hold labelled text of either kind.  A
text is cut into pieces, so that its own history does not outweigh a dictionary;
all pieces are compressed with each dictionary, and the difference of the summed
sizes over their sum, (bad - good) / (bad + good), is calibrated by isotonic
regression on labelled rows outside the dictionaries.

Scores lie in [0, 1], higher for label 1.  Null and empty texts have difference
0.  A sample that lacks a label gives everything one score: the share of label 1
(0.5 where there are no rows).  Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm import labelled, scan
from webquarry.llm.boosting import Isotonic
from webquarry.llm.udf import text_udf, with_struct

#: Bytes of a piece and of a dictionary, and the zstandard level.
PIECE, DICTIONARY, LEVEL = 512, 1000 << 10, 3


def build_dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """Pieces of the texts taken in turn up to ``size`` bytes, the shortest texts' first pieces last."""
    pieces: list[bytes] = []
    have, turn = 0, 0
    data = [t.encode() for t in texts]
    while have < size and any(len(d) > turn * PIECE for d in data):
        for d in data:
            if (p := d[turn * PIECE : turn * PIECE + PIECE]) and have < size:
                pieces.append(p)
                have += len(p)
        turn += 1
    return b"\n".join(reversed(pieces))[-size:]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    calibrate: Isotonic | None
    constant: float = 0.5

    def open(self):
        """A function from a chunk of texts to normalised differences."""
        if not self.good or not self.bad:
            return lambda chunk: np.zeros(len(chunk))
        pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]
        good, bad = (c.compress for c in pair)

        def difference(chunk: pa.Array) -> np.ndarray:
            buf, off = scan.raw(chunk)
            data = buf.tobytes()
            out = np.zeros(len(chunk))
            for i in range(len(chunk)):
                a = b = 0
                for at in range(off[i], off[i + 1], PIECE):
                    piece = data[at : min(at + PIECE, off[i + 1])]
                    a += len(good(piece))
                    b += len(bad(piece))
                out[i] = (b - a) / (off[i + 1] - off[i]) if off[i + 1] > off[i] else 0.0
            return out

        return difference


def fit_quality(rows: list[tuple[str, int]]) -> QualityModel:
    """A model from (text, label) pairs: a third for the dictionaries, the rest to calibrate."""
    y = np.array([v for _, v in rows], dtype=float)
    if len(y) < 6 or y.min() == y.max():
        return QualityModel(b"", b"", None, float(y.mean()) if len(y) else 0.5)
    for_dict = np.zeros(len(y), dtype=bool)
    for v in (0, 1):
        own = np.flatnonzero(y == v)
        for_dict[own[:: 3 if len(own) > 2 else 2]] = True
    texts = lambda v: [rows[i][0] for i in np.flatnonzero(for_dict & (y == v))]
    model = QualityModel(build_dictionary(texts(1)), build_dictionary(texts(0)), None)
    rest = np.flatnonzero(~for_dict)
    if not model.good or not model.bad or len(set(y[rest])) < 2:
        return QualityModel(b"", b"", None, float(y.mean()))
    difference = model.open()
    x = np.concatenate([difference(c) for c in scan.chunks(pa.array([rows[i][0] for i in rest], type=pa.string()))])
    model.calibrate = Isotonic(x, y[rest])
    return model


def score_quality(df: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.7, prefix: str = "") -> DataFrame:
    """df with score and predicted (1 at the threshold or above); clashing columns are replaced."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        ready = sent.value
        difference = ready.open()

        def one(chunk: pa.Array) -> dict:
            d = difference(chunk)
            p = ready.calibrate(d) if ready.calibrate else np.full(len(chunk), ready.constant)
            return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

        return one

    return with_struct(df, text_udf("score double, predicted int", start)(F.col(f"`{text_col}`").cast("string")), ["score", "predicted"], prefix)


#: Labelled rows that a model is fitted on, at most.
ROWS = 6000
FOLDS, HELD = 4, 2


def fitted(documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> QualityModel:
    """A model from the folds of ``labels`` that are not held out."""
    return fit_quality(labelled.sample(documents, labels, "quality", FOLDS, HELD, rows))

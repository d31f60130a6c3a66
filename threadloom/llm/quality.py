"""Quality classifier by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages. Each passage is encoded by what its bytes and words look like (shares of kinds of characters,
word lengths, repetition) and a learned layer. Labels exist for documents only; gated attention learns which passages decide,

    a = softmax over passages of  w . (tanh(V h) * sigmoid(U h)),     score = sigmoid(c . sum(a h) + c0),

so that one bad passage in a long clean text can count as much as it should. Every passage of every text is scored. The model is
fitted on the driver from a bounded sample of labelled rows (max_train documents, those of least hashed id).
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fold, table, text_groups, trim

WINDOW = 400
MAX_TRAIN = 6000
THRESHOLD = 0.3
WIDTH, GATE, EPOCHS, RATE, DECAY = 16, 8, 300, 0.02, 1e-4

_kinds = [string.ascii_lowercase, string.ascii_uppercase, string.digits, " \t", "\n\r\x0b\x0c", ".", ",", "!?", "|", "%*$#&@~^_=+<>/\\", "'\"-;:()[]{}`"]
KIND = np.full(256, len(_kinds), np.uint8)
for _k, _chars in enumerate(_kinds):
    KIND[list(_chars.encode())] = _k
KIND[128:192] = len(_kinds) + 1
KIND[192:] = len(_kinds) + 2
N_KINDS = len(_kinds) + 3
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
MARK = (KIND >= 5) & (KIND <= 10)
POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)
N_FEATURES = N_KINDS + 9


def encode_passages(texts: list[str], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and how many each text has (an empty text: one, of zeros and a flag)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    n = np.maximum(1, -(-sizes // window))
    base = np.cumsum(n) - n
    start = np.cumsum(sizes + 1) - sizes - 1
    at = np.arange(len(data), dtype=np.int64)
    p = np.minimum((at - np.repeat(start, sizes + 1)) // window, np.repeat(n - 1, sizes + 1)) + np.repeat(base, sizes + 1)
    total = int(n.sum())
    inside = np.ones(len(data), bool)
    inside[start + sizes] = False
    counts = np.bincount(p[inside] * N_KINDS + KIND[data[inside]], minlength=total * N_KINDS).reshape(total, N_KINDS).astype(np.float64)
    size = counts.sum(1)
    per = 1 / np.maximum(size, 1)
    blank = BLANK[data]
    first = ~blank & np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(first)
    same = np.concatenate([[False], data[1:] == data[:-1]])
    doubled = np.bincount(p[same & MARK[data]], minlength=total)
    out = np.zeros((total, N_FEATURES))
    out[:, :N_KINDS] = counts * per[:, None]
    if len(starts):
        begin = np.maximum.accumulate(np.where(first, at, 0))
        with np.errstate(over="ignore"):
            value = np.where(blank, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * POWERS[np.minimum(at - begin, 63)])
            word = np.add.reduceat(value, starts)
        length = np.add.reduceat((~blank).astype(np.int64), starts)
        wp = p[starts]
        words = np.bincount(wp, minlength=total)
        again = np.concatenate([[False], (word[1:] == word[:-1]) & (wp[1:] == wp[:-1])])
        key = np.unique((wp.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
        distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=total)
        w = 1 / np.maximum(words, 1)
        mean = np.bincount(wp, length, total) * w
        spread = np.sqrt(np.maximum(np.bincount(wp, length**2.0, total) * w - mean**2, 0))
        out[:, N_KINDS : N_KINDS + 6] = np.stack([words * per * 5, mean / 8, np.minimum(spread, 50) / 8, distinct * w, np.bincount(wp[again], minlength=total) * w, np.bincount(wp[length > 20], minlength=total) * w], 1)
    out[:, N_KINDS + 6] = doubled * per
    out[:, N_KINDS + 7] = np.log1p(size) / 6
    out[:, N_KINDS + 8] = size == 0
    return out.astype(np.float32), n


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class AttentionBags:
    """The model: parameters, and the mean and scale of features."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        d = N_FEATURES
        self.p = {"w": r.normal(0, d**-0.5, (d, WIDTH)), "b": np.zeros(WIDTH), "v": r.normal(0, WIDTH**-0.5, (WIDTH, GATE)), "u": r.normal(0, WIDTH**-0.5, (WIDTH, GATE)), "a": r.normal(0, GATE**-0.5, GATE), "c": r.normal(0, WIDTH**-0.5, WIDTH), "c0": np.zeros(1)}
        self.mean, self.scale = np.zeros(d), np.ones(d)

    def forward(self, x: np.ndarray, n: np.ndarray):
        p, at = self.p, np.cumsum(n) - n
        h = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        a = e / np.repeat(np.add.reduceat(e, at), n)
        z = np.add.reduceat(a[:, None] * h, at)
        return _sigmoid(z @ p["c"] + p["c0"]), (h, t, g, a, z, at)

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.forward(x, n)[0]

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> AttentionBags:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        p = self.p
        p["c0"][0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        m1 = {k: np.zeros_like(v) for k, v in p.items()}
        m2 = {k: np.zeros_like(v) for k, v in p.items()}
        scaled = ((x - self.mean) / self.scale).clip(-8, 8)
        for step in range(1, epochs + 1):
            s, (h, t, g, a, z, at) = self.forward(x, n)
            do = (s - y) / len(y)
            dz = np.repeat(do[:, None] * p["c"], n, 0)
            da = (dz * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, at), n))
            dg = de[:, None] * p["a"]
            dt, du = dg * g * (1 - t**2), dg * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ p["v"].T + du @ p["u"].T) * (1 - h**2)
            grad = {"w": scaled.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ du, "a": (t * g).T @ de, "c": z.T @ do, "c0": np.array([do.sum()])}
            for k in p:
                grad[k] = grad[k] + DECAY * p[k] * (k not in ("b", "c0"))
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


FEATURES = "doc_id long, n long, x binary"


def _features(batches):
    for batch in batches:
        ids = batch.column(0)
        for first, texts in text_groups(batch):
            x, n = encode_passages(texts)
            cut = np.split(x, np.cumsum(n)[:-1])
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(n), pa.array([c.tobytes() for c in cut], pa.binary())], ["doc_id", "n", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, test_fold: int = 0) -> AttentionBags:
    """Fit on at most max_train labelled documents outside the test fold. A document with several labels has the least; of rows that repeat an id one is taken, chosen by a hash of the text; null ids and labels are left out. What reaches the driver is a few numbers for each 400 bytes of these texts. Without two classes, as of empty tables, the model is untrained and scores 0.5 or its bias."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != test_fold)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label_col).alias("__y"))
    chosen = y.orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"), "left_semi")
    # of rows that repeat an id, one, chosen by its text
    rows = rows.groupBy("doc_id").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    bags = {r.doc_id: r for r in rows.mapInArrow(_features, FEATURES).collect()}
    known = {r["__id"]: r["__y"] for r in chosen.collect()}
    ids = sorted(i for i in known if i in bags)
    model = AttentionBags()
    target = np.array([known[i] > 0 for i in ids], float)
    if len(set(target)) == 2:
        x = np.frombuffer(b"".join(bags[i].x for i in ids), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
        model.fit(x, np.array([bags[i].n for i in ids], np.int64), target)
    return model


def score_quality(docs: DataFrame, model: AttentionBags, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (id_col by default) of each row of docs, with score (0 to 1) and predicted. Null and empty texts are scored as a bag of one empty passage; rows that repeat are scored each; a very long text is as many passages as it has. Columns that aren't in `keep` aren't read, whatever they are called."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or [id_col]
    names = [*keep, "score"]

    def run(batches):
        trim()
        for batch in batches:
            scores: list[np.ndarray] = []
            for _, texts in text_groups(batch, "__text"):
                scores.append(shared.value.score(*encode_passages(texts)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names)

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", score double"
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")

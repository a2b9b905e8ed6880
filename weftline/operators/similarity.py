"""Text and vector similarity."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (len a + len b), by bit-parallel longest common subsequence; 100 for two empty texts."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def indel_ratios(texts: list[str], i: np.ndarray, j: np.ndarray, at_once: int = 16384) -> np.ndarray:
    """`indel_ratio` of texts i[k] and j[k] for every k: the same bits, in words of 64, of many pairs at a time."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    letters = {c: k for k, c in enumerate(sorted({c for t in texts for c in t}), 1)}
    said = np.zeros((len(texts), int(size.max(initial=0))), dtype=np.int32)  # 0: no letter, changes nothing
    for k, t in enumerate(texts):
        said[k, : len(t)] = [letters[c] for c in t]
    words = max(1, -(-said.shape[1] // 64))
    masks = np.zeros((len(texts), len(letters) + 1, words), dtype=np.uint64)
    for c in range(said.shape[1]):
        masks[np.arange(len(texts)), said[:, c], c // 64] |= np.uint64(1 << (c % 64))
    masks[:, 0] = 0
    out = np.empty(len(i))
    a, b = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    order = np.lexsort((size[b], -(-size[a] // 64)))
    for k in range(0, len(order), at_once):
        at = order[k : k + at_once]
        x, y = a[at], b[at]
        w = max(1, -(-int(size[x].max()) // 64))
        s = [np.full(len(at), ~np.uint64(0)) for _ in range(w)]
        for c in range(int(size[y].max())):
            m, carry = masks[x, said[y, c]], None
            for n in range(w):
                u = s[n] & m[:, n]
                total = s[n] + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64) if n + 1 < w else None
                s[n] = total | (s[n] ^ u)
        common = sum(np.bitwise_count(~v).astype(np.int64) for v in s)
        both = size[x] + size[y]
        out[at] = np.where(both == 0, 100.0, 200.0 * common / np.maximum(both, 1))
    return out


def by_token(text: str | None) -> str:
    return " ".join(sorted((text or "").split()))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two texts with their tokens sorted; null texts count as empty."""
    return pd.Series([indel_ratio(by_token(x), by_token(y)) for x, y in zip(a, b)])


def grams(df: DataFrame, key: str, text: str, low: int = 2, high: int = 4) -> DataFrame:
    """(key, gram, n): character n-grams within words, each word between two spaces."""
    word = F.explode(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")).alias("w")
    padded = df.select(key, word).filter("w <> ''").select(key, F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    each = F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length("w"))), lambda n: F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substring(F.col("w"), i, n))))
    return padded.select(key, F.explode(each).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def tfidf(df: DataFrame, key: str, text: str, times: str | None = None) -> DataFrame:
    """(key, gram, w): sublinear term frequency, smoothed idf, unit length; a row counts `times` times in the idf.

    Keys with equal texts have equal weights: these are found once a text, and its keys take them over.
    """
    total = df.filter(F.col(text).isNotNull()).agg((F.sum(times) if times else F.count("*")).alias("total"))
    # the rows of one key are one text: its words count together
    count = F.coalesce(F.max(times), F.lit(0)) if times else F.lit(1)
    bags = df.filter(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(text)), " ").alias("bag"), count.alias("times"))
    texts = bags.groupBy("bag").agg(F.sum("times").alias("times"))
    g = grams(texts, "bag", "bag")
    df_ = g.join(texts, "bag").groupBy("gram").agg(F.sum("times").alias("df")).crossJoin(total)  # total has one row
    raw = g.join(df_, "gram").select("bag", "gram", ((1 + F.log("n")) * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)).alias("w"))
    v = raw.groupBy("bag").agg(F.collect_list(F.struct("gram", "w")).alias("ws"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    each = bags.filter(F.col(key).isNotNull()).select(key, "bag").join(v, "bag").select(key, F.inline("ws"), "len")
    return each.select(key, "gram", (F.col("w") / F.col("len")).alias("w"))


def cosine_pairs(weights: DataFrame, blocks: DataFrame, key: str, block: str, floor: float) -> DataFrame:
    """(a, b, sim), a < b of one block, by an inverted index: only pairs sharing a gram meet."""
    w = weights.join(blocks.select(key, block), key)
    a = w.select(F.col(key).alias("a"), block, "gram", F.col("w").alias("wa"))
    b = w.select(F.col(key).alias("b"), block, "gram", F.col("w").alias("wb"))
    return a.join(b, [block, "gram"]).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim")).filter(F.col("sim") >= floor)


#: Rows of the pairs of texts' records that are listed at once; records of a block that meet in one task.
LISTED, RECORDS = 1 << 18, 8192


def text_pairs(df: DataFrame, key: str, text: str, block: str, floor: float) -> DataFrame:
    """(a, b, sim), a < b of one block, sim to four places: each two texts of a block are compared once, and their records take it over."""
    said = df.filter(F.col(text).isNotNull()).select(F.col(block).alias("block"), F.col(key).alias("id"), F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")).alias("t"))
    rows = said.filter("block is not null and id is not null and t <> ''")
    total = df.agg(F.count("*").alias("total"))  # records without a text count too

    def listed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _listed(key, batches, floor)

    kind = df.schema[key].dataType.simpleString()
    return compared(rows, frequencies(said), total, RECORDS).applyInArrow(listed, f"a {kind}, b {kind}, sim double")


def _slices(size: np.ndarray):
    """Ranges whose sizes add up to LISTED, or of one whose size is larger."""
    end, k = np.cumsum(size), 0
    while k < len(size):
        n = max(k + 1, int(np.searchsorted(end, (end[k - 1] if k else 0) + LISTED, "right")))
        yield k, n
        k = n


def _each(size: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _listed(key: tuple, batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """(a, b, sim) of the records of two groups of a block, or of one."""
    tile, x, y = read_tile(key, batches)
    t = tile.slice(0, len(tile) - tile["id"].null_count)
    if not len(t):
        return
    coded = pc.dictionary_encode(t["t"]).combine_chunks()
    texts = coded.dictionary
    text = np.argsort(pc.sort_indices(texts))[coded.indices]
    first = np.unique(text, return_index=True)[1]
    weights, ids, parts = text_weights(t.take(pa.array(first)), tile), t["id"].to_numpy(), []
    # of each text, where its records of either group lie
    for part in (x,) if y is None else (x, y):
        part = part[np.argsort(text[part], kind="stable")]
        own = np.bincount(text[part], minlength=len(texts))
        parts.append((ids[part], np.cumsum(own) - own, own))
    (p_ids, p_first, p_size), (q_ids, q_first, q_size) = parts[0], parts[-1]

    def rows(r, start, size, s):
        """Each record r with `size` others from `start` on."""
        for low, high in _slices(size):
            n = size[low:high]
            p, q = np.repeat(p_ids[r[low:high]], n), q_ids[np.repeat(start[low:high], n) + _each(n)]
            apart = p != q
            if not apart.all():
                p, q, v = p[apart], q[apart], np.repeat(s[low:high], n)[apart]
            else:
                v = np.repeat(s[low:high], n)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(v)], ["a", "b", "sim"])

    def crossed(i, j, s):
        for low, high in _slices(p_size[i]):
            n = p_size[i[low:high]]
            r = np.repeat(p_first[i[low:high]], n) + _each(n)
            m = np.repeat(j[low:high], n)
            yield from rows(r, q_first[m], q_size[m], np.repeat(s[low:high], n))

    of_x, of_y = np.flatnonzero(p_size), np.flatnonzero(q_size)
    if y is None:
        # a text's own records: each with those that follow it
        n = np.repeat(p_first + p_size, p_size)
        r = np.arange(len(p_ids))
        yield from rows(r, r + 1, n - r - 1, np.ones(len(r)))
    for i, j, s in near(weights, of_x, None if y is None else of_y, floor):
        yield from crossed(i, j, _rounded(s))


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(2, min(4, len(w)) + 1) for i in range(len(w) - n + 1)]


class _Words:
    """Words and their grams by number, each word cut once."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        self.of: list[list[int]] = []

    def ids(self, text: str) -> list[int]:
        out = []
        for w in text.split(" "):
            if w:
                k = self.words.get(w)
                if k is None:
                    k = self.words[w] = len(self.of)
                    self.of.append([self.grams.setdefault(g, len(self.grams)) for g in _grams(w)])
                out.append(k)
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, gram, n), sorted, by numbers."""
        ids = [self.ids(t) for t in texts]
        flat = np.fromiter((k for x in ids for k in x), dtype=np.int64)
        text = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        size = np.fromiter(map(len, self.of), dtype=np.int64, count=len(self.of))
        all_ = np.fromiter((g for x in self.of for g in x), dtype=np.int64, count=int(size.sum()))
        start, n = (np.cumsum(size) - size)[flat], size[flat]
        at = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
        width = max(1, len(self.grams))
        keys = np.sort(np.repeat(text, n) * width + all_[at])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        return keys[first] // width, keys[first] % width, np.diff(np.append(first, len(keys)))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, df): of a partition's texts, how many hold each gram."""
    words, df = _Words(), np.zeros(0, dtype=np.int64)
    for pdf in batches:
        text, gram, _ = words.counts(pdf["t"].tolist())
        now = np.bincount(gram, pdf["times"].to_numpy()[text] if "times" in pdf else None, minlength=len(words.grams)).astype(np.int64)
        now[: len(df)] += df
        df = now
    if words.grams:  # a partition without texts has no row: pandas would give its grams no type
        yield pd.DataFrame({"gram": list(words.grams), "df": df})


def frequencies(rows: DataFrame, *times: str) -> DataFrame:
    """(gram, df) over the normalised texts t of all records, counted without a shuffle of every text's grams; a row may stand for `times` records."""
    return rows.select("t", *(F.col(c).alias("times") for c in times)).mapInPandas(_counted, "gram string, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def _weights(texts: list[str], df: dict[str, int], total: int, words: _Words | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each text the places and weights of its grams, of unit length; and how many places there are."""
    words = words or _Words()
    text, gram, n = words.counts(texts)
    idf = np.log((1 + total) / (1 + np.array([df[g] for g in words.grams], dtype=np.float64))) + 1
    w = (1 + np.log(n)) * idf[gram]
    w /= np.sqrt(np.bincount(text, w * w, len(texts)))[text]
    ends = np.searchsorted(text, np.arange(1, len(texts)))
    return list(zip(np.split(gram, ends), np.split(w, ends))), len(words.grams)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    m = np.zeros((len(rows), width))
    for i, (u, w) in enumerate(rows):
        m[i, u] = w
    return m


def _rounded(v: np.ndarray, places: int = 4) -> np.ndarray:
    """To so many places as Spark's round does: half up, by the number's shortest decimal form."""
    near = v * 10**places
    out = np.floor(near + 0.5) / 10**places
    for k in np.flatnonzero(np.abs(near - np.floor(near) - 0.5) < 1e-6):
        out[k] = float(Decimal(repr(float(v[k]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return out


#: Texts that are compared at once.
LEFT, RIGHT = 256, 1024


def compared(rows: DataFrame, frequencies: DataFrame, total: DataFrame, group: int):
    """rows (block, id, t, ...) grouped so that each two of a block meet in one task: whole blocks, those of more than `group` rows two groups at a time.

    Each group holds its texts' grams too, with df and total; `read_tile` and `text_weights` read what a task gets.
    """
    large = rows.groupBy("block").agg(F.ceil(F.count("*") / group).alias("groups")).filter("groups > 1")  # at most a row for each `group` rows
    rows = rows.join(F.broadcast(large), "block", "left").withColumn("groups", F.coalesce("groups", F.lit(1).cast("long")))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id"), "groups"))
    at = ["block", "groups", "g"]
    word = rows.select(*at, F.explode(F.array_distinct(F.split("t", " "))).alias("w")).filter("w <> ''").distinct().withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
    gram = F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(4), F.length("w"))), lambda n: F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substring("w", i, n))))
    counted = word.select(*at, F.explode(gram).alias("gram")).distinct().join(frequencies, "gram").crossJoin(F.broadcast(total))  # one row
    both = rows.unionByName(counted, allowMissingColumns=True)
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    return both.withColumns({"low": F.least("g", "other"), "high": F.greatest("g", "other")}).drop("groups", "other").groupBy("block", "low", "high")


def read_tile(key: tuple, batches) -> tuple[pa.Table, np.ndarray, np.ndarray | None]:
    """(what a task of `compared` gets, places of the rows of one group, of the other or None if there is one only)."""
    t = pa.Table.from_batches(list(batches))
    t = pa.concat_tables([t.filter(pc.is_valid(t["id"])), t.filter(pc.is_null(t["id"]))])
    low, high = key[1].as_py(), key[2].as_py()
    n = len(t) - t["id"].null_count
    g, texts = t["g"].to_numpy()[:n], t["t"][:n].to_pylist()
    # like texts together, which have fewer grams
    order = np.array(sorted(range(n), key=texts.__getitem__), dtype=np.int64)
    return t, order[g[order] == low], None if low == high else order[g[order] == high]


def text_weights(rows: pa.Table, tile: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row the numbers and weights of its text's grams, of unit length."""
    counted = tile.filter(pc.is_valid(tile["gram"])).select(["gram", "df", "total"])
    df, total = dict(zip(counted["gram"].to_pylist(), counted["df"].to_pylist())), counted["total"][0].as_py() if len(counted) else 0
    words, out, texts = _Words(), [], rows["t"].to_pylist()
    for low in range(0, len(texts), 4096):  # as many at once as memory allows
        got, _ = _weights(texts[low : low + 4096], df, total, words)
        u, w = np.concatenate([u for u, _ in got]).astype(np.int32), np.concatenate([w for _, w in got])
        ends = np.cumsum([len(u) for u, _ in got])[:-1]
        out += zip(np.split(u, ends), np.split(w, ends))
    return out


def near(weights: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray | None, floor: float):
    """(i, j, similarity) of the texts of x and y, or of each two of x, from the floor on; some tiles at a time."""
    width = 1 + max((int(u.max()) for u, _ in weights if len(u)), default=0)
    place = np.full(width, -1)
    for low in range(0, len(x), LEFT):
        a = x[low : low + LEFT]
        own = np.unique(np.concatenate([weights[n][0] for n in a]))
        place[own] = np.arange(len(own))
        left = _placed([weights[n] for n in a], place, len(own))
        b_all = x[low:] if y is None else y
        for first in range(0, len(b_all), RIGHT):
            b = b_all[first : first + RIGHT]
            s = left @ _placed([weights[n] for n in b], place, len(own)).T
            i, j = np.nonzero(s >= floor)
            if y is None:
                k = i < j + first
                i, j = i[k], j[k]
            if len(i):
                yield a[i], b[j], s[i, j]
        place[own] = -1


def _placed(rows: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, width: int) -> np.ndarray:
    """The rows' weights at the places of their grams; those without a place meet none."""
    m = np.zeros((len(rows), width))
    k = np.repeat(np.arange(len(rows)), [len(u) for u, _ in rows])
    at, w = place[np.concatenate([u for u, _ in rows])], np.concatenate([w for _, w in rows])
    has = at >= 0
    m[k[has], at[has]] = w[has]
    return m


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_pairs(vectors: DataFrame, key: str, block: str, vector: str) -> DataFrame:
    """(a, b, sim) of all vectors of one block, a < b."""
    a = vectors.select(F.col(key).alias("a"), block, F.col(vector).alias("va"))
    b = vectors.select(F.col(key).alias("b"), block, F.col(vector).alias("vb"))
    return a.join(b, block).filter("a < b").select("a", "b", dot("va", "vb").alias("sim"))

"""Self-join of texts on the Jaccard similarity of their word shingles, with Bayesian pruning of candidates.

1. A text's MinHash values give band keys; texts that share a band key are candidates. With the default bands a pair at the
   threshold shares none with a probability of 5e-6, a more similar pair with less.
2. Inside a bucket every text is compared with the bucket's least text, then the texts that fall off are compared with all others of
   the bucket, in blocks of bounded size. A comparison reads MinHash values a few at a time and drops the pair as soon as the
   posterior probability of reaching the threshold, from a uniform prior, is below the tolerance. What is left joins texts to clusters.
3. All pairs inside a cluster are verified exactly, in blocks of bounded size; each text gets the number of texts it is linked to, and
   links join texts to classes. Copies are one text with a weight throughout, and pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import materialise, sized, spread
from serieslab.llm.graphs import components

#: Bands, MinHash values to a band, and values that comparisons may read, of which a byte each is kept.
BANDS, ROWS, COMPARED, STEP = 40, 6, 64, 16
#: Texts to a block of a bucket and of a cluster, and shingles to a block of a cluster.
BLOCK, EXACT_BLOCK, EXACT_SHINGLES = 256, 256, 1_000_000
#: Rows of blocks to a task, and the most tasks.
TASK_ROWS, TASKS = 1_000, 20_000
CLASSES = "text_key binary, root binary, links bigint"


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word; words are what ASCII white space parts."""
    words = text.split()
    return np.fromiter(map(hash_word, words), np.uint64, len(words))


@lru_cache(1 << 17)
def hash_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """A 64-bit hash for each run of `size` words, repeats included; a shorter text with a word is one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(w))):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[k : k + n]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 32, n, np.uint32)[:, None], (rng.integers(0, 1 << 31, n, np.uint32) * 2 + 1)[:, None].astype(np.uint32)


def minhash(hashes: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    xor, times = family
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        block = x[None, k : k + 512] ^ xor
        block *= times
        np.minimum(out, block.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """doc_id, text_key (null where the text has no word), the number of shingles, bands and the compared bytes."""
    rows = docs.select(F.col(key).alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_key"), F.col(text).cast("binary").alias("body"))
    kind = dict(rows.dtypes)["doc_id"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _family()
        rng = np.random.default_rng(11)
        mix = rng.integers(1, 1 << 62, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        own = rng.integers(0, 1 << 62, BANDS, np.uint64)
        for b in batches:
            keys, sizes, bands, kept = [], [], [], []
            for k, t in zip(b.column(1), b.column(2), strict=True):
                h = shingle_hashes(t.as_py() or b"", size)
                if not len(h):
                    keys.append(None), sizes.append(0), bands.append(None), kept.append(None)
                    continue
                m = minhash(h, family)
                keyed = (m.reshape(BANDS, ROWS).astype(np.uint64) * mix).sum(axis=1, dtype=np.uint64) + own
                keyed ^= keyed >> np.uint64(31)
                keyed *= np.uint64(0x94D049BB133111EB)
                keys.append(k.as_py()), sizes.append(len(h)), bands.append(keyed.view(np.int64)), kept.append((m[:COMPARED] & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "text_key", "shingles", "bands", "kept"])

    return rows.mapInArrow(sign, f"doc_id {kind}, text_key binary, shingles bigint, bands array<bigint>, kept binary")


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After so many compared values, the fewest equal ones with which the posterior probability of a similarity of at least the
    threshold is not below the tolerance. Values are single bytes, so unequal ones look equal once in 256 times."""
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = {}
    for n in range(STEP, COMPARED + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(logs - logs.max())
            if w[s >= threshold].sum() >= tolerance * w.sum():
                out[n] = m
                break
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """For rows of compared bytes, pair by pair: which are not dropped."""
    alive, equal, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, m in least.items():
        equal = equal + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        stay = equal >= m
        alive, equal, done = alive[stay], equal[stay], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def find_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' components."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from rows that are sorted by the keys; only a group at a time is held beyond a batch."""
    held: list[pd.DataFrame] = []
    for b in batches:
        frame = b.to_pandas()
        if not len(frame):
            continue
        change = np.zeros(len(frame), bool)
        for k in keys:
            v = frame[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change), len(frame)]
        if held and any(held[-1][k].iat[-1] != frame[k].iat[0] for k in keys):
            yield pd.concat(held, ignore_index=True)
            held = []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if s:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[s:e])
    if held:
        yield pd.concat(held, ignore_index=True)


def bucket_edges(hits: DataFrame, compared: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (u, v) that join the texts of each bucket whose pairs survive. hits: (bucket, text_key)."""
    least = least_matches(threshold, tolerance)

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        as_rows = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        return pd.Series(survivors(as_rows(a), as_rows(b), least))

    buckets = hits.groupBy("bucket").agg(F.count("*").alias("n"), F.min("text_key").alias("leader")).where("n > 1")
    buckets = materialise(buckets.join(compared.select(F.col("text_key").alias("leader"), F.col("kept").alias("leader_kept")), "leader"))
    members = hits.join(sized(buckets, 200_000), "bucket").where("text_key <> leader").join(compared, "text_key")
    tested = materialise(members.select("bucket", "n", "text_key", "leader", "kept", close("kept", "leader_kept").alias("near")))
    stars = tested.where("near").select(F.col("text_key").alias("u"), F.col("leader").alias("v")).distinct()
    fallen = materialise(tested.where("n > 2 and not near").groupBy("bucket").agg(F.count("*").alias("far"), F.first("n").alias("m")))
    rest = tested.where("n > 2").join(sized(fallen.drop("m")), "bucket")
    cut = lambda n: f"cast(ceil(({n}) / {BLOCK}) as int)"
    own = "cast(pmod(xxhash64(text_key), %s) as int)"
    far_n, near_n = cut("far"), cut("n - 1 - far")
    far = rest.where("not near").select("bucket", "text_key", "kept", F.expr(far_n).alias("f"), F.expr(near_n).alias("a"), F.expr(own % far_n).alias("i"))
    within = far.select("bucket", "text_key", "kept", "i", F.expr("explode(sequence(0, f - 1))").alias("k")).selectExpr(
        "bucket", "'far' as kind", "least(i, k) as i", "greatest(i, k) as j", "true as side", "text_key", "kept"
    )
    across = far.where("a > 0").select("bucket", F.lit("near").alias("kind"), "i", F.expr("explode(sequence(0, a - 1))").alias("j"), F.lit(True).alias("side"), "text_key", "kept")
    near = rest.where("near").select("bucket", F.lit("near").alias("kind"), F.expr(f"explode(sequence(0, {far_n} - 1))").alias("i"), F.expr(own % near_n).alias("j"), F.lit(False).alias("side"), "text_key", "kept")
    keys = ["bucket", "kind", "i", "j"]

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, keys):
            kept = np.frombuffer(b"".join(g["kept"]), np.uint8).reshape(len(g), -1)
            side = g["side"].to_numpy(bool)
            rows = np.flatnonzero(side)
            cols = rows if g["kind"].iat[0] == "far" else np.flatnonzero(~side)
            left, right = [], []
            for r in rows:
                others = cols[cols > r] if cols is rows else cols
                found = others[survivors(np.broadcast_to(kept[r], (len(others), kept.shape[1])), kept[others], least)]
                left.append(np.full(len(found), r)), right.append(found)
            if not rows.size or not sum(map(len, left)):
                continue
            root = find_roots(len(g), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(root != np.arange(len(g)))
            names = g["text_key"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(names[moved], pa.binary()), pa.array(names[root[moved]], pa.binary())], ["u", "v"])

    blocks = within.union(across).union(near)
    n_rows = fallen.selectExpr(f"far * ({far_n} + {cut('m - 1 - far')}) + (m - 1 - far) * {far_n} as r").agg(F.sum("r")).first()[0] or 0
    more = spread(blocks, n_rows, keys, TASK_ROWS, TASKS).sortWithinPartitions(*keys).mapInArrow(join_blocks, "u binary, v binary")
    return stars.union(more.distinct())


def exact_links(clusters: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """(text_key, root, links): what verified pairs give each text of a cluster. clusters: (node, component, shingles); texts: (text_key, n,
    body). links is the number of rows, copies counted, that the text is linked to, apart from its own copies."""
    cut = f"cast(ceil(greatest(count(*) / {EXACT_BLOCK}, sum(shingles) / {EXACT_SHINGLES})) as int) as parts"
    counts = materialise(clusters.groupBy("component").agg(F.count("*").alias("m"), F.expr(cut)))
    rows = clusters.drop("shingles").join(counts, "component").join(texts.withColumnRenamed("text_key", "node"), "node")
    placed = rows.selectExpr("component", "node", "n", "body", "cast(pmod(xxhash64(node), parts) as int) as own", "explode(sequence(0, parts - 1)) as k")
    blocks = placed.selectExpr("component", "least(own, k) as i", "greatest(own, k) as j", "own", "node", "n", "body")
    keys = ["component", "i", "j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, keys):
            sets = [np.unique(shingle_hashes(t, size)) for t in g["body"]]
            lengths, n = np.array([len(s) for s in sets]), len(sets)
            names, at = np.unique(np.concatenate(sets), return_inverse=True)
            who = np.repeat(np.arange(n), lengths)
            common = np.zeros((n, n), np.float32)
            order = np.argsort(at, kind="stable")
            at, who = at[order], who[order]
            width = max(256, (1 << 22) // n)
            for k in range(0, len(names), width):
                s, e = np.searchsorted(at, [k, k + width])
                x = np.zeros((n, width), np.float32)
                x[who[s:e], at[s:e] - k] = 1
                common += x @ x.T
            both = common.astype(np.int64)
            linked = both >= threshold * (lengths[:, None] + lengths[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            own = g["own"].to_numpy()
            if g["i"].iat[0] != g["j"].iat[0]:
                linked &= own[:, None] != own[None, :]
            root = find_roots(n, *np.nonzero(linked))
            nodes = g["node"].to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(nodes[root], pa.binary()), pa.array(linked @ g["n"].to_numpy(np.int64), pa.int64())],
                ["text_key", "root", "links"],
            )

    n_rows = counts.agg(F.sum(F.col("m") * F.col("parts"))).first()[0] or 0
    return spread(blocks, n_rows, keys, TASK_ROWS, TASKS).sortWithinPartitions(*keys).mapInArrow(verify, CLASSES)


def _classes(docs: DataFrame, threshold: float, size: int, tolerance: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and a row for each text that has copies or links: text_key, first_id (the least doc_id of its rows), n (its
    rows), class_id, n_links, leads (whether it is the one text that stands for its class)."""
    signed = materialise(signatures(docs, size, key, text))
    reps = materialise(
        signed.where("text_key is not null").groupBy("text_key").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"), F.first("kept").alias("kept")
        )
    )
    hits = reps.select(F.explode("bands").alias("bucket"), "text_key")
    edges = bucket_edges(hits, reps.select("text_key", "kept"), threshold, tolerance)
    clusters = materialise(components(edges).join(reps.select(F.col("text_key").alias("node"), "shingles"), "node"))
    wanted = sized(clusters.select(F.col("node").alias("text_key")))
    own = docs.select(F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_key"), F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    firsts = reps.join(wanted, "text_key", "left_semi").select("text_key", "n", F.col("first_id").alias("doc_id"))
    texts = _texts(own, materialise(firsts))
    verified = materialise(exact_links(clusters, texts, size, threshold))
    links = verified.groupBy("text_key").agg(F.sum("links").alias("links"))
    linked = components(verified.select(F.col("text_key").alias("u"), F.col("root").alias("v")))
    of_text = reps.select("text_key", "first_id", "n").join(linked.withColumnRenamed("node", "text_key"), "text_key", "left").join(links, "text_key", "left")
    of_text = materialise(of_text.where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "text_key")))
    lead = F.min_by("text_key", F.struct(F.col("first_id").isNull(), "first_id", "text_key"))
    ids = of_text.groupBy("component").agg(F.min("first_id").alias("class_id"), lead.alias("lead"))
    classes = of_text.join(ids, "component").select(
        "text_key", "first_id", "n", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), (F.col("text_key") == F.col("lead")).alias("leads")
    )
    return signed, materialise(classes)


def similarity_classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, class_id (the least doc_id of its class) and n_links (the number of other rows whose
    shingle sets have a Jaccard similarity of at least the threshold with its own; copies are counted).

    Classes are the connected components of the links. A text under `size` words is a single shingle. Null and empty texts, and
    texts of white space, have no shingles: no links, and class_id is their doc_id. Null keys are passed on; a class of null keys
    only has a null class_id. Repeated rows are copies of one another. Other columns are not read, whatever their names."""
    signed, classes = _classes(docs, threshold, size, tolerance, key, text)
    found = sized(classes.select("text_key", "class_id", "n_links"))
    return signed.select("doc_id", "text_key").join(found, "text_key", "left").select(
        "doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def one_of_each_class(docs: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, all columns kept, without all but one of each class of `similarity_classes`.

    It is a row of the class's least key (null keys last, of equal keys the text with the least hash); of several rows with this key and
    text the one with the least hash of all columns. Rows are told apart by their texts, so a key may be repeated or null. Rows without
    words belong to no class and all stay."""
    _, classes = _classes(docs, threshold, size, tolerance, key, text)
    found = sized(classes.select(F.col("text_key").alias("_sl_key"), F.col("first_id").alias("_sl_first"), F.col("n").alias("_sl_n"), F.col("leads").alias("_sl_leads")))
    rows = docs.withColumn("_sl_text", F.unhex(F.md5(F.coalesce(text, F.lit(""))))).join(found, F.col("_sl_text") == F.col("_sl_key"), "left")
    single = rows.where("_sl_key is null or _sl_leads and _sl_n = 1").select(*docs.columns)
    repeated = rows.where(F.col("_sl_leads") & (F.col("_sl_n") > 1) & F.col(key).eqNullSafe(F.col("_sl_first")))
    one = repeated.groupBy("_sl_text").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_sl_row")).select("_sl_row.*")
    return single.unionByName(one)


def _texts(own: DataFrame, firsts: DataFrame) -> DataFrame:
    """(text_key, n, body) for the wanted texts, each once."""
    f = sized(firsts.select(F.col("text_key").alias("f_key"), F.col("doc_id").alias("f_id"), "n"))
    found = own.join(f, (own["text_key"] == f["f_key"]) & own["doc_id"].eqNullSafe(f["f_id"]))
    return found.select("text_key", "n", "body").dropDuplicates(["text_key"])

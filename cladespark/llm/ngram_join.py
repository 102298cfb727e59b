"""Jaccard self-join of documents on word n-grams: MinHash LSH forest, then exact verification.

A document is the set of its runs of NGRAM words; one with fewer words is one
run, one without words has none and is alone. Documents with equal sets are
one node, so copies, however many, cost one node.

1. Each node has a path of DEEPEST MinHash values in each of TREES trees. Sorted
   by path, a tree is a prefix trie, and nodes with an equal prefix are
   candidates. `floor_depth` is the longest prefix at which pairs at the
   threshold t are met with probability RECALL, 1 - (1 - t ** depth) ** TREES;
   paths whose prefix of that length nobody shares are dropped.
2. From DEEPEST on, nodes with an equal prefix are compared by all their MinHash
   values; those that agree enough (SIGMAS standard deviations below t) are
   tied. The recall at this depth follows from the similarities of the ties
   met, each of which stands for 1 / (probability to be met) pairs, and of one
   more pair at t. While it is below RECALL, the matched prefixes are shortened
   by one value: only branches of the trie that now come together are compared,
   pairs of one branch were before. At `floor_depth` the recall is met in any case.
   Large prefixes are cut into blocks and compared block by block, so no task
   holds more than two blocks, nothing is capped, and ties between groups that
   are known to hang together are not passed on again.
3. In each component of the ties, texts are compared exactly, again by blocks:
   an intersection is a product of 0/1 matrices. What leaves a block is a
   count of links for each node and a tie to its root, not the pairs.

The result has a row for each row of the input: doc_id, class_id (the smallest
doc_id of its component of exact links), n_links (other sets with a Jaccard
similarity of the threshold or more), n_copies (rows with an equal set). Null
ids are kept; a class of null ids alone has a null class_id. Repeated rows are
copies. Equal texts have equal class, links and copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm import components, staging, words

NGRAM, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 24, 6, 0.99999
SIGMAS = 6
#: Nodes of a block when signatures are compared, and when texts are.
BLOCK, TEXT_BLOCK = 250, 150
#: N-grams of a component for each further block of texts, for the sake of very long ones.
TEXT_BLOCK_GRAMS = 2_000_000
#: Log of the bits that say which texts are wanted for exact comparison.
MOST_BITS = 26


def met(similarity, depth: int, trees: int):
    """Probability that a pair shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def floor_depth(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix at which pairs at the threshold are met with that probability."""
    depths = [d for d in range(deepest, 0, -1) if met(threshold, d, trees) >= recall]
    if not depths:
        raise ValueError(f"{trees} trees cannot meet a recall of {recall} at a similarity of {threshold}")
    return depths[0]


def least_agreement(threshold: float, values: int) -> int:
    """MinHash values, of so many, that pairs at the threshold agree in but for SIGMAS standard deviations."""
    return max(1, int(np.ceil(threshold * values - SIGMAS * np.sqrt(threshold * (1 - threshold) * values))))


def gram_sets(buf: np.ndarray, bounds: np.ndarray, n: int = NGRAM) -> list[np.ndarray]:
    """Sorted hashes of the different n-grams of each document."""
    start, end, doc = words.word_spans(buf, bounds)
    hashed = words.span_hashes(buf, start, end)
    gram, at = words.grams(hashed, doc, n)
    first = np.searchsorted(doc[at], np.arange(len(bounds)))
    word = np.searchsorted(doc, np.arange(len(bounds)))
    out = []
    for d in range(len(bounds) - 1):
        if first[d] < first[d + 1]:
            out.append(np.unique(gram[first[d] : first[d + 1]]))
        elif word[d] < word[d + 1]:
            few = hashed[word[d] : word[d + 1]]
            out.append(words.grams(few, np.zeros(len(few), np.int64), len(few))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(grams: np.ndarray) -> int:
    """Of a set of n-grams; sets that differ have different ones but for 64-bit collisions."""
    with np.errstate(over="ignore"):
        return int(words.mix(np.array([words.mix(grams + words.BASE).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def signatures(docs: DataFrame, floor: int, trees: int = TREES, deepest: int = DEEPEST, n: int = NGRAM) -> DataFrame:
    """(doc_id, key, node, grams, labels, signature); node is null where there are no n-grams.

    A label is the hash of a tree's prefix of `floor` values; the signature has
    the low byte of each value, tree by tree, in the order of the path.
    """
    rng = np.random.default_rng(99)
    factors = rng.integers(1, 2**63, trees * deepest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, trees * deepest, dtype=np.uint64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, labels, signs = [], [], [], []
            for _, _, buf, bounds in words.slices(batch.column(2)):
                sets = gram_sets(buf, bounds, n)
                full = [g for g in sets if len(g)]
                least = np.zeros((trees * deepest, len(full)), np.uint64)
                if full:
                    every = np.concatenate(full)
                    at = np.cumsum([0] + [len(g) for g in full[:-1]])
                    for k in range(trees * deepest):
                        least[k] = np.minimum.reduceat((every * factors[k] + shifts[k]) >> np.uint64(32), at)
                path = np.zeros((trees, len(full)), np.uint64)
                for k in range(floor):
                    path = path * words.BASE + least[k::deepest]
                path = words.mix(path + np.arange(1, trees + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)).view(np.int64).T
                sign = (least & np.uint64(255)).astype(np.uint8).T
                i = 0
                for g in sets:
                    size.append(len(g))
                    node.append(fingerprint(g) if len(g) else None)
                    labels.append(path[i] if len(g) else [])
                    signs.append(np.ascontiguousarray(sign[i]).tobytes() if len(g) else b"")
                    i += len(g) > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(labels, pa.list_(pa.int64())), pa.array(signs, pa.binary())], ["doc_id", "key", "node", "grams", "labels", "signature"])

    source = keyed(docs)
    return source.mapInArrow(each, f"doc_id {dict(source.dtypes)['doc_id']}, key long, node long, grams long, labels array<long>, signature binary")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a key that only rows with equal id and text share, and the text."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", row_key(docs).alias("key"), text.alias("text"))


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"].cast("string"))


def _first(doc_id: str) -> Column:
    """Key of the row with the smallest id, null ids last."""
    return F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col("key")))["key"]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows with equal first `keys` columns, several at a time; rows come sorted."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        last = [table.column(k)[-1].as_py() for k in range(keys)]
        changed = np.zeros(table.num_rows, bool)
        for k in range(keys):
            changed |= table.column(k).to_numpy() != last[k]
        cut = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0
        if not cut:
            if rest and any(rest[0].column(k)[0].as_py() != last[k] for k in range(keys)):
                yield pa.concat_tables(rest)
                rest = []
            rest.append(table)
            continue
        yield pa.concat_tables([*rest, table.slice(0, cut)])
        rest = [table.slice(cut)]
    if rest:
        yield pa.concat_tables(rest)


def _numbered(table: pa.Table, keys: int) -> np.ndarray:
    """Number of each row's group."""
    new = np.zeros(table.num_rows, bool)
    for k in range(keys):
        column = table.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component, a < b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, b, root[a])
        np.minimum.at(root, a, root[b])
        root = root[root]
        if (root == before).all():
            return root


def trie(nodes: DataFrame, floor: int, deepest: int) -> DataFrame:
    """(label, tail, node, signature): the paths whose first `floor` values another node shares.

    `tail` has the rest of the path, a byte a value; rows with equal label and
    equal first bytes of the tail are a branch.
    """
    rows = nodes.select("node", F.posexplode("labels").alias("tree", "label"))
    shared = rows.groupBy("label").agg(F.count("*").alias("size")).filter("size > 1").select("label")
    tail = F.substring(F.col("signature"), F.col("tree") * deepest + floor + 1, F.lit(deepest - floor))
    return rows.join(shared, "label").join(nodes.select("node", "signature"), "node").select("label", tail.alias("tail"), "node", "signature")


def ties(paths: DataFrame, depth: int, floor: int, deepest: int, need: int, threshold: float) -> DataFrame:
    """(a, b, agree) at one depth: ties that join the nodes alike within each pair of blocks of nodes with an equal prefix.

    Nodes of one branch were compared at the depth before, and nodes of one block
    where the block meets itself; only ties between the groups that those make
    are passed on, so their number follows that of the nodes. `agree` is the
    least agreement, not below the threshold, of the pairs that a tie stands for; null without such a pair.
    """
    at = lambda d: F.xxhash64("label", F.substring(F.col("tail"), F.lit(1), F.lit(d - floor)))
    rows = paths.withColumn("prefix", at(depth)).withColumn("branch", at(depth + 1) if depth < deepest else F.col("node"))
    joining = rows.groupBy("prefix").agg(F.count("*").alias("size"), F.min("branch").alias("x"), F.max("branch").alias("y")).filter("x != y").select("prefix", "size")
    shared = rows.join(joining, "prefix")
    dealt = _blocks(shared, "prefix", F.ceil(F.col("size") / BLOCK).cast("int"), ["prefix"], ["node", "branch", "signature"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            group = _numbered(table, 3)
            block, node, branch = (table.column(k).to_numpy() for k in (3, 4, 5))
            mixed = table.column(1).to_numpy() != table.column(2).to_numpy()
            sign = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint8).reshape(len(node), -1)
            pairs, alike, live, k = [], [], np.arange(len(node)), 1
            while len(live):
                live = live[live + k < len(node)]
                live = live[group[live] == group[live + k]]
                for at in range(0, len(live), 4096):
                    part = live[at : at + 4096]
                    agree = (sign[part] == sign[part + k]).sum(1)
                    pairs.append(np.stack([part, part + k])[:, agree >= need])
                    alike.append(agree[agree >= need] / sign.shape[1])
                k += 1
            if not pairs:
                continue
            (a, b), alike = np.concatenate(pairs, 1), np.concatenate(alike)
            known = (branch[a] == branch[b]) | (mixed[a] & (block[a] == block[b]))
            before, root = _roots(len(node), a[known], b[known]), _roots(len(node), a, b)
            least, near = np.full(len(node), 2.0), alike >= threshold
            np.minimum.at(least, root[a[near]], alike[near])
            tied = np.flatnonzero((before == np.arange(len(node))) & (root != before))
            yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[root[tied]]), pa.array(least[root[tied]], mask=least[root[tied]] > 1)], ["a", "b", "agree"])

    return dealt.mapInArrow(each, "a long, b long, agree double")


def forest_ties(nodes: DataFrame, threshold: float, trees: int, deepest: int, recall: float) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(a, b) of all depths gone through, and the estimated recall at each of them."""
    floor = floor_depth(threshold, trees, deepest, recall)
    need = least_agreement(threshold, trees * deepest)
    paths = staging.stage(trie(nodes, floor, deepest), "trie")
    found, steps = None, []
    for depth in range(deepest, floor - 1, -1):
        level = staging.stage(ties(paths, depth, floor, deepest, need, threshold), "ties")
        found = level if found is None else found.unionByName(level)
        # A pair is met in several trees and blocks; its smallest similarity stands for it.
        once = found.groupBy("a", "b").agg(F.min("agree").alias("s"))
        number, stands_for = once.agg(F.count("s"), F.sum(1 / met(F.col("s"), depth, trees))).first()
        steps.append((depth, ((number or 0) + 1) / ((stands_for or 0.0) + 1 / met(threshold, depth, trees))))
        if steps[-1][1] >= recall:
            break
    return found.select("a", "b"), steps


def _blocks(rows: DataFrame, group: str, blocks, keys: list[str], values: list[str]) -> DataFrame:
    """Rows dealt to pairs of blocks of their group: keys, low, high, block, values; sorted in each partition."""
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*keys, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *values)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, group, "low", "high").sortWithinPartitions(group, "low", "high", "node")


def _links(sets: list[np.ndarray], block: np.ndarray, mixed: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose sets are at least that similar."""
    sizes = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step = max(1, 8_000_000 // len(sets))
    for low in range(0, int(code[-1]) + 1, step):  # so many different n-grams at a time
        s, e = np.searchsorted(code, [low, low + step])
        table = np.zeros((len(sets), min(step, int(code[-1]) + 1 - low)), np.float32)
        table[owner[s:e], code[s:e] - low] = 1
        common += table @ table.T
    union = sizes[:, None] + sizes[None] - common
    near = np.triu(common >= threshold * union - 1e-6, 1)
    if mixed:
        near &= block[:, None] != block[None]
    return np.nonzero(near)


def _sifted(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """texts(key, text) without most rows whose key is not among the keys; a join has to follow.

    Keys set bits by their hash in a table of at most 2 ** MOST_BITS bits, so
    what is broadcast is bounded. With more keys than bits more rows pass.
    """
    n = keys.count()
    bits = 1 << min(MOST_BITS, max(10, (16 * n).bit_length()))
    slot = F.pmod(F.xxhash64("key"), F.lit(bits))
    words_ = keys.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int"))).alias("b")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words_.w.to_numpy(int)] = words_.b

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy()
            yield batch.filter(pa.array(table[s >> 6] >> (s & 63) & 1 == 1)).select([0, 1])

    return texts.select("key", "text", slot.alias("slot")).mapInArrow(each, "key long, text string")


def links(docs: DataFrame, members: DataFrame, threshold: float, n: int = NGRAM) -> DataFrame:
    """(node, root, links): exact links of each node in each pair of blocks of its component, and a tie."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"), F.sum("grams").alias("all_grams"))
    blocks = F.ceil(F.greatest(F.col("size") / TEXT_BLOCK, F.col("all_grams") / TEXT_BLOCK_GRAMS)).cast("int")
    placed = members.join(sizes, "root").select("node", F.col("root").alias("component"), "key", blocks.alias("b"))
    texts = _sifted(keyed(docs).drop("doc_id"), placed).join(placed, "key")
    dealt = _blocks(texts, "component", F.col("b"), ["component"], ["node", "text"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            group = _numbered(table, 3)
            node = table.column(4).to_numpy()
            sets: list[np.ndarray] = []
            for chunk in table.column(5).chunks:
                for _, _, buf, bounds in words.slices(chunk):
                    sets += gram_sets(buf, bounds, n)
            # An id may stand for several texts, and a text for several rows: one row of the right text is enough.
            right = np.array([fingerprint(s) == v for s, v in zip(sets, node, strict=True)], bool)
            right[1:] &= ~((group[1:] == group[:-1]) & (node[1:] == node[:-1]) & right[:-1])
            low, high, block = (table.column(k).to_numpy() for k in (1, 2, 3))
            out: list[tuple[np.ndarray, ...]] = []
            rows = np.flatnonzero(right)
            if not len(rows):
                continue
            for part in np.split(rows, np.flatnonzero(np.diff(group[rows])) + 1):
                a, b = _links([sets[i] for i in part], block[part], low[part[0]] != high[part[0]], threshold) if len(part) > 1 else (np.zeros(0, int),) * 2
                count = np.bincount(a, minlength=len(part)) + np.bincount(b, minlength=len(part))
                out.append((node[part], node[part][_roots(len(part), a, b)], count))
            columns = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "root", "links"])

    return dealt.mapInArrow(each, "node long, root long, links long")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, n: int = NGRAM) -> DataFrame:
    """(doc_id, key, class_key, class_id, n_links, n_copies) of every row of docs(doc_id, text)."""
    staging.small_batches(docs.sparkSession)
    signed = staging.stage(signatures(docs, floor_depth(threshold, trees, deepest, recall), trees, deepest, n), "signatures")
    full = signed.filter("node is not null")
    nodes = full.groupBy("node").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("least"), _first("doc_id").alias("key"), F.first("grams").alias("grams"), F.first("labels").alias("labels"), F.first("signature").alias("signature"))
    nodes = staging.stage(nodes, "nodes")
    tied = components.components(forest_ties(nodes, threshold, trees, deepest, recall)[0])
    members = staging.stage(tied.join(nodes.select("node", "key", "grams"), "node"), "members")
    found = staging.stage(links(docs, members, threshold, n), "links")
    classes = components.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    known = nodes.select("node", "n_copies", "least", "key").join(classes, "node", "left").join(counted, "node", "left")
    known = staging.stage(known.withColumn("root", F.coalesce("root", "node")).fillna(0, ["n_links"]), "known")
    first = known.groupBy("root").agg(F.min("least").alias("class_id"), _first("least").alias("class_key"), F.count("*").alias("class_nodes"))
    total = nodes.agg(F.count("*"), F.sum("n_copies")).first()
    first = staging.stage(first, "classes")
    named = staging.stage(staging.lookup(known, first, "root", "class_nodes", total[0]).select("node", "class_id", "class_key", "n_links", "n_copies"), "named")
    out = staging.lookup(full.select("doc_id", "key", "node"), named, "node", "n_copies", total[1] or 0).drop("node")
    alone = signed.filter("node is null").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.col("key").alias("class_key"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(alone)


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(staging.documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")

"""MinHash near-duplicates with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import SMALL_BYTES, held, map_texts
from quern.llm.components import components
from quern.scratch import materialize

#: 30 bands of 5: a pair of similarity 0.85 shares none with probability 2e-8, one of 0.8 with 7e-6.
BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
#: Signature values compared at a time, and the posterior probability of a true link below which a pair is dropped.
BATCH, MISS = 30, 1e-6
#: Buckets up to this size give pairs; of larger ones each member is compared with one representative, and what that leaves block by block, with at most about BLOCK members each.
SMALL, BLOCK = 16, 400
#: A node of so few large buckets is compared in its other bands alone: a pair at the threshold of 0.85 shares none of 27 with probability 1.3e-7, one of 0.8 with 2.2e-5.
FEW_LARGE = 3
#: Ids and labels, of up to 50 bytes, that may be broadcast, and bytes of the sets of representatives that may.
BROADCAST_IDS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Rows of one word sequence from which its label is spread by a broadcast.
HOT = 10_000

_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _word_hashes() -> _WordHashes:
    return held("word_hashes", _WordHashes)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], k: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of each text: digest of its word sequence, and all shingles (64-bit hashes, distinct and ascending) with the first place of each text's.

    A-Z are lowered; words are runs without white space. With fewer than k words the sequence is one shingle; without words there is none.
    """
    words = [t.encode().lower().split() if t else [] for t in texts]
    digests = [hashlib.md5(b" ".join(w)).digest() for w in words]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter(map(_word_hashes().__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    parts_h, parts_d = [], []
    if len(flat) >= k:
        at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            h += flat[at + j] * _STEP[j]
        parts_h.append(_mix(h))
        parts_d.append(doc[at])
    short = [i for i, w in enumerate(words) if 0 < len(w) < k]
    if short:
        parts_h.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i]), seed=len(words[i])) for i in short], dtype=np.uint64))
        parts_d.append(np.array(short, dtype=np.int64))
    if not parts_h:
        return digests, np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    h, d = np.concatenate(parts_h), np.concatenate(parts_d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return digests, h, np.searchsorted(d, np.arange(len(texts) + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint32 minima of every text by HASHES; texts without shingles have zeros."""
    out = np.zeros((len(first) - 1, HASHES), dtype=np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        starts = first[some]
        for j in range(HASHES):
            out[some, j] = np.minimum.reduceat((((h ^ _XOR[j]) * _MUL[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            keys[:, b] += (sig[:, b * ROWS + r].astype(np.uint64) + np.uint64(b + 1)) * _STEP[8 + r]
        keys[:, b] = _mix(keys[:, b])
    return keys.astype(np.int64)


@cache
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For BATCH, 2 BATCH, ... compared values: the fewest matches at which P(similarity >= threshold | matches) is still `miss`, from a uniform prior."""
    grid = (np.arange(4000) + 0.5) / 4000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Indices of rows of the signature pairs (a, b) that no batch's posterior rules out."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k, least in enumerate(least_matches(threshold)):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, cols] == b[alive, cols]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exactly 100 * intersection >= percent * union of two sets of distinct shingles."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sig(values: list[bytes], kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=kind).reshape(-1, HASHES)


def _halves(values: list[bytes]) -> np.ndarray:
    """Low halves of signature values. Equal values have equal halves, so a pair that survives by its values does by its halves; others match by 2^-16 a value."""
    return _sig(values, "<u2")


def _sets(values: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype="<u8") for v in values]


def likely_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v, su, sv), halves of signatures, to the pairs (u, v) that no batch rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = survivors(*(_halves(batch.column(c).to_pylist()) for c in ("su", "sv")), percent / 100)
                yield batch.select(["u", "v"]).take(pa.array(alive))

    return pairs.mapInArrow(run, "u binary, v binary")


def linked_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v, xu, xv) to the links (u, v): whole sets are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [is_link(x, y, percent) for x, y in zip(*(_sets(batch.column(c).to_pylist()) for c in ("xu", "xv")))]
            yield batch.select(["u", "v"]).filter(pa.array(links, pa.bool_()))

    return pairs.mapInArrow(run, "u binary, v binary")


def verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (u, v), a written table, and sets (node, half, shingles) to the links: signatures first, batch by batch, then the sets of the pairs that are left. Sets are the bulk, so few pairs go to them and not they to the pairs."""
    halves = lambda a, b: sets.select(F.col("node").alias(a), F.col("half").alias(b))
    likely = materialize(likely_pairs(halves("u", "su").join(_few(pairs), "u").join(halves("v", "sv"), "v"), percent), "likely")
    mine, theirs = (sets.select(F.col("node").alias(a), F.col("shingles").alias(b)) for a, b in (("u", "xu"), ("v", "xv")))
    if likely.count() <= BROADCAST_IDS:
        theirs = theirs.join(F.broadcast(likely.select("v").distinct()), "v", "left_semi")
    return linked_pairs(mine.join(_few(likely), "u").join(theirs, "v"), percent)


def _in_block(sig: np.ndarray, side: np.ndarray, band: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, matches): pairs of one pair of blocks that no batch rules out and that share this band first; in a band below 0, of buckets merged, all that no batch rules out."""
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    for i in left.tolist():
        others = right[right > i] if side[i] == 2 else right
        if not len(others):
            continue
        alive = others[survivors(np.broadcast_to(sig[i], (len(others), HASHES)), sig[others], percent / 100)]
        if len(alive):
            same = sig[alive] == sig[i]
            first = same.reshape(len(alive), BANDS, ROWS).all(axis=2).argmax(axis=1) == band if band >= 0 else np.ones(len(alive), dtype=bool)
            yield i, alive[first], same.sum(axis=1)[first]


def block_links(nodes: list[bytes], sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray, band: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Links of one pair of blocks, enough of them to connect what is connected.

    Each pair is treated in the first band that it shares. Likely pairs go first; pairs that verified links connect already are left out, the others are verified exactly.
    """
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found_i, found_j, found_m = [], [], []
    for i, others, matches in _in_block(sig, side, band, percent):
        found_i.append(np.full(len(others), i))
        found_j.append(others)
        found_m.append(matches)
    out = []
    if found_i:
        ii, jj, mm = np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_m)
        for k in np.argsort(-mm, kind="stable").tolist():
            i, j = int(ii[k]), int(jj[k])
            a, b = find(i), find(j)
            if a != b and is_link(sets[i], sets[j], percent):
                root[a] = b
                out.append((nodes[i], nodes[j]))
    return out


def likely_members(members: DataFrame, percent: int) -> DataFrame:
    """members (bucket, band, i, j, side, node, half) to those that have a pair for their group to treat. The others' sets needn't be sent there."""
    kept = ["bucket", "band", "i", "j", "side", "node"]

    def work(table: pa.Table) -> pa.Table:
        some = np.zeros(table.num_rows, dtype=bool)
        for i, others, _ in _in_block(_halves(table.column("half").to_pylist()), np.asarray(table.column("side")), table.column("band")[0].as_py(), percent):
            some[others] = True
            some[i] |= len(others) > 0
        return table.select(kept).filter(pa.array(some))

    return members.groupBy("bucket", "i", "j").applyInArrow(work, members.select(kept).schema)


def verified_blocks(members: DataFrame, percent: int) -> DataFrame:
    """members (bucket, band, i, j, side, node, sig, shingles) to links (u, v); a group (bucket, i, j) holds two blocks at most."""

    def work(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        links = block_links(nodes, _sig(table.column("sig").to_pylist()), _sets(table.column("shingles").to_pylist()), np.asarray(table.column("side")), table.column("band")[0].as_py(), percent)
        return pa.table({"u": pa.array([a for a, _ in links], pa.binary()), "v": pa.array([b for _, b in links], pa.binary())})

    return members.groupBy("bucket", "i", "j").applyInArrow(work, "u binary, v binary")


def compared_with_one(pairs: DataFrame, percent: int) -> DataFrame:
    """(node, rep, xu, xv) to (node, rep, linked, near): whether the sets link, and whether node could link to another member that links to rep.

    1 - similarity is a metric, so a node farther from rep than twice the threshold allows links with nothing that links to rep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x, "<u8") for x in batch.column(c).to_pylist()] for c in ("xu", "xv")]
            linked = [is_link(x, y, percent) for x, y in zip(*sets)]
            near = [a or is_link(x, y, 2 * percent - 100) for a, x, y in zip(linked, *sets)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("rep"), pa.array(linked, pa.bool_()), pa.array(near, pa.bool_())], ["node", "rep", "linked", "near"])

    return pairs.mapInArrow(run, "node binary, rep binary, linked boolean, near boolean")


def _few(df: DataFrame) -> DataFrame:
    """df, a written table, to be broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _blocks(column: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(column) / BLOCK)).cast("int")


def _sizes(state: DataFrame) -> DataFrame:
    """(bucket, n_rest, n_near, n_linked) of the buckets with a rest, and the rows that their blocks take."""
    rest = state.filter("NOT linked").groupBy("bucket").agg(F.count_if("crowded").alias("n_rest"), F.count_if("near").alias("n_near"))
    sizes = rest.join(state.filter("linked").groupBy("bucket").agg(F.count("*").alias("n_linked")), "bucket")
    among = F.when(F.col("n_rest") > 1, F.col("n_rest") * _blocks("n_rest")).otherwise(0)
    across = F.when(F.col("n_near") > 0, F.col("n_near") * _blocks("n_linked") + F.col("n_linked") * _blocks("n_near")).otherwise(0)
    return sizes.withColumn("n_rows", among + across)


def merged_buckets(state: DataFrame, roots: DataFrame) -> DataFrame:
    """state (bucket, band, node, linked, near, crowded) with buckets in whose members one component (roots: node, root) leads made one, of band -1, where that takes fewer rows of blocks.

    Copies of one text share many bands, so their buckets hold the same texts up to BANDS times, and links of any bucket have connected most of them.
    In a merged bucket each text stands once, members of the leading component are the linked ones, and all others that aren't left to their small buckets are compared with them and among themselves.
    """
    rooted = materialize(state.join(_few(roots), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    leading = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.min(F.struct((-F.col("n")).alias("n"), "root"))["root"].alias("lead"))
    leading = materialize(leading, "leading")
    keys = leading.groupBy("lead").agg(F.min("bucket").alias("key"))
    leading = materialize(leading.join(_few(materialize(keys, "keys_of_leads")), "lead"), "leads")
    whole = rooted.join(_few(leading), "bucket").groupBy(F.col("key").alias("bucket"), "node").agg(F.first(F.col("root") == F.col("lead")).alias("linked"), F.max(F.col("near") | F.col("crowded")).alias("near"), F.first("crowded").alias("crowded"))
    whole = materialize(whole, "merged")
    apart = leading.join(_few(materialize(_sizes(state).select("bucket", "n_rows"), "rows_apart")), "bucket").groupBy("key").agg(F.sum("n_rows").alias("n_apart"))
    once = materialize(_sizes(whole).select(F.col("bucket").alias("key"), F.col("n_rows").alias("n_once")), "rows_once")
    better = materialize(apart.join(_few(once), "key", "left").filter(F.coalesce("n_once", F.lit(0)) < F.col("n_apart")).select("key"), "better")
    merged = leading.join(_few(better), "key", "left_semi").select("bucket")
    kept = state.join(_few(materialize(merged, "merged_away")), "bucket", "left_anti")
    return kept.unionByName(whole.join(_few(better.select(F.col("key").alias("bucket"))), "bucket", "left_semi").withColumn("band", F.lit(-1)))


def large_bucket_links(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """members (bucket, band, node) of large buckets, sets (node, sig, half, shingles) and the links (u, v) of small buckets to links (u, v), which with those connect what is connected.

    Every member is verified against the least node of its bucket, its representative. Members that link to it are connected, so no pair of them is compared again.
    The others, the rest, are compared among themselves, and those of them that could link to a connected member with the connected ones, block against block.
    Of the rest, texts that share a header but not more are in few large buckets, and whatever they link to shares small buckets with them; they are left to those, and only members of more than FEW_LARGE large buckets go on.
    So a bucket of n near copies costs n comparisons of whole sets, one of n texts with a common header as many, and one with a rest of m in many large buckets costs m * ceil(m / BLOCK) rows more.
    Buckets of the same texts are first merged by the components that all links so far make, so that the rest of a large group of near copies is what no link has reached, once and not once a band.
    Those rows carry halves of signatures; sets follow only to the groups in which a member has a pair that its signature doesn't rule out and that shares no band before.
    """
    crowded = materialize(members.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > FEW_LARGE).select("node", F.lit(True).alias("crowded")), "crowded")
    reps = members.groupBy("bucket").agg(F.min("node").alias("rep"))
    placed = materialize(members.join(_few(materialize(reps, "reps")), "bucket"), "placed")
    theirs = materialize(placed.select(F.col("rep").alias("node")).distinct().join(sets, "node").select(F.col("node").alias("rep"), F.col("shingles").alias("xv")), "rep_sets")
    light = int(theirs.agg(F.sum(F.octet_length("xv"))).first()[0] or 0) <= BROADCAST_BYTES
    apart = materialize(placed.filter("node <> rep").select("node", "rep").distinct(), "apart")
    pairs = sets.select("node", F.col("shingles").alias("xu")).join(_few(apart), "node").join(F.broadcast(theirs) if light else theirs, "rep")
    judged = materialize(compared_with_one(pairs, percent), "judged")
    state = placed.join(judged, ["node", "rep"], "left").select("bucket", "band", "node", F.coalesce("linked", F.lit(True)).alias("linked"), F.coalesce("near", F.lit(True)).alias("near"))
    state = materialize(state.join(_few(crowded), "node", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))), "state")
    own_links = judged.filter("linked").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    roots = materialize(components(links.unionByName(own_links)), "roots_so_far")
    state = materialize(merged_buckets(state, roots), "state")
    sizes = materialize(_sizes(state), "sizes")
    own = lambda c: F.pmod(F.xxhash64("node"), _blocks(c)).cast("int")
    sized = state.join(_few(sizes), "bucket")
    apart = sized.filter("NOT linked AND crowded AND n_rest > 1").select("bucket", "band", "node", own("n_rest").alias("own"), F.explode(F.sequence(F.lit(0), _blocks("n_rest") - 1)).alias("other"))
    among = apart.select("bucket", "band", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    # rest against connected: blocks of the rest are numbered below 0
    left = sized.filter("NOT linked AND near").select("bucket", "band", "node", (-1 - own("n_near")).alias("i"), F.explode(F.sequence(F.lit(0), _blocks("n_linked") - 1)).alias("j"), F.lit(0).alias("side"))
    right = sized.filter("linked AND n_near > 0").select("bucket", "band", "node", F.explode(F.sequence(F.lit(0), _blocks("n_near") - 1)).alias("i"), own("n_linked").alias("j"), F.lit(1).alias("side"))
    across = left.unionByName(right.withColumn("i", -1 - F.col("i")))
    blocks_of = materialize(among.unionByName(across), "blocks")
    likely = materialize(likely_members(sets.select("node", "half").join(_few(blocks_of), "node"), percent), "in_blocks")
    found = verified_blocks(sets.select("node", "sig", "shingles").join(_few(likely), "node"), percent)
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found)


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (least id that links reach), kept (component_id is its own id).

    Equal word sequences are one node, so copies are never paired. Nodes that share a band are candidates: small buckets give distinct pairs,
    larger ones go by large_bucket_links(), whose tasks emit no more links than connect what is connected.
    Links are verified on full sets. Only a pair that shares no band (2e-8 at the threshold of 0.85) or whose posterior is below MISS is lost.
    Null and blank texts have no shingles and link with nothing. Rows of null id take part; a component's id ignores null unless all are. Repeated ids are rows of their own.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession

    def make_keys():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests, h, first = shingle_sets(batch.column("text").to_pylist(), k)
            keys = band_keys(signatures(h, first))
            n = np.diff(first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), lists], ["id", "node", "n_shingles", "bands"])

        return work

    def make_sets():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests, h, first = shingle_sets(batch.column("text").to_pylist(), k)
            sig = signatures(h, first).astype("<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (sig, sig.astype("<u2"))), pa.array([h[a:b].astype("<u8").tobytes() for a, b in zip(first, first[1:])], pa.binary())],
                ["node", "sig", "half", "shingles"],
            )

        return work

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    rows = materialize(map_texts(texts, "text", make_keys, f"id {kind}, node binary, n_shingles long, bands array<long>", SMALL_BYTES), "keys")
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    banded = nodes.select("node", "rep", F.posexplode("bands").alias("band", "bucket"))
    shared = materialize(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = materialize(banded.join(_few(shared), "bucket"), "members")

    wanted = materialize(members.select("node", "rep").distinct(), "wanted")
    ids = wanted.select(F.col("rep").alias("id")).distinct()
    n_wanted = wanted.count()
    few = n_wanted <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(ids) if few else ids, texts["id"].eqNullSafe(ids["id"]), "left_semi")
    sets = materialize(map_texts(chosen.select("text"), "text", make_sets, "node binary, sig binary, half binary, shingles binary", SMALL_BYTES), "sets")
    if sets.count() > n_wanted:  # every wanted node is there; only repeated ids bring others or bring one twice, else no set is sent anywhere to find that out
        sets = materialize(sets.join(_few(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"]), "distinct_sets")

    small = members.filter(F.col("n") <= SMALL).select("bucket", "node")
    pairs = small.select("bucket", F.col("node").alias("u")).join(small.select("bucket", F.col("node").alias("v")), "bucket").filter("u < v").select("u", "v").distinct()
    links, large = verified_pairs(materialize(pairs, "pairs"), sets, percent), members.filter(F.col("n") > SMALL).select("bucket", "band", "node")
    if not large.isEmpty():
        links = large_bucket_links(large, sets, links, percent)
    roots = materialize(components(links), "roots")
    # blank texts share a node but link with nothing; a text that stands once and links with nothing is its own group and takes no part in a join
    words = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    reps = materialize(words.join(roots, "node", "left").filter("root IS NOT NULL OR times > 1"), "grouped")
    linked = reps.filter("root IS NOT NULL")
    least = materialize(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    labels = linked.join(_few(least), "root").select("node", "times", "component_id").unionByName(reps.filter("root IS NULL").select("node", "times", F.col("rep").alias("component_id")))
    labels = materialize(labels, "labels")
    hot = _few(materialize(labels.filter(F.col("times") >= HOT).select("node", "component_id"), "hot"))  # a label for HOT rows
    slim = rows.select("id", "node", "n_shingles")
    many = slim.join(hot, "node").select("id", "n_shingles", "component_id")
    others = slim.join(hot.select("node"), "node", "left_anti").join(_few(labels.filter(F.col("times") < HOT).select("node", "component_id")), "node", "left")
    others = others.select("id", "n_shingles", F.when(F.col("component_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    out = many.unionByName(others)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

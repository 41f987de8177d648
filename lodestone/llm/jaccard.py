"""Exact Jaccard join of word n-gram sets by universe partitioning and the pigeonhole.

**Signatures.** The universe of tokens (64-bit hashes of n-grams) is cut into segments, as
many as the set's size band asks for. Two sets that are similar enough differ in at most
H tokens; each differing token spoils one segment, so of more than H segments one is left
whole. A set therefore emits one hash for each of some segments, and similar sets meet in
at least one hash. A segment may also be given its one-deletion neighbourhood (the hashes
of the segment without each of its tokens): it then survives one difference and counts
for two units. Which and how many segments a band has of either kind is chosen by cost,
from the number of sets in the band: hashes to emit against chance meetings to check.

**Which segments.** Of the exact segments a set keeps its H+1 largest (ties by content),
the least selective ones stay out. Two similar sets share at least spare+1 segments and
order shared ones alike, so the best shared segment is kept by both: no link is lost.

**Bands.** A set emits under its own band's scheme and under lower bands' that partners
can lie in, so any two similar sets share the scheme of the smaller one.

**Candidates without all pairs.** Equal sets are one node. In a group of sets that meet in
a hash, all are checked against two pivots first (linear); the links' components are
computed; then, only where a group still spans several components, pairs across
components are compared, the smaller side in blocks against all members, with a parity
sketch as an exact upper bound of the similarity. Pairs inside a component cannot change
it. A cell gives its undecided pairs where these are few for its rows, else a forest that
connects them, so its output is in proportion to its input. Pairs are compared by a sketch
that grows with their sets. A forest's trees are groups of a second comparison by a longer
sketch. What is left is joined to trees, the groups of the last step, where
each set travels once (not once a hash): again the smaller side in blocks against all
members, now on the whole token sets, and again each cell gives a forest, of true links.
Large groups are split over tasks by blocks. Without the longer sketches, chance meetings of
long sets would join more and more sets to one tree, which is compared in a time and space
that grow with the square of its size.

**Disk.** Hashes are matched in rounds, each over a slice of the hashes' values, and sets are
verified in rounds, each over a part of the pairs; so are groups that span components, and
blocks whose rows together are far more than their groups'. A round's shuffles go before the next one. Few texts take fewer rounds, as every round costs
the driver its plans, shuffles and threads, however little is in it.
The hashes themselves go as soon as all have been matched.

**Verification** is exact, on the whole token sets (of 64-bit hashes).

Edge cases: a text without words (null, empty) has an empty set and no link; with fewer
words than n its whole sequence is its one token; repeated rows are one node; null ids
take part, and a component's id is its smallest non-null id (null if it has none); an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, delete_path, drop_cut, free_shuffles, give_back, maybe_in, mix, not_null_text, number_rows, scratch, steps, stored, table, utf8, words
from lodestone.llm.components import components

SKETCH = 4  # 64-bit words of the parity sketch
LONG = 64  # and of the longer one, by which the trees of undecided pairs are compared
FEW = 8  # undecided pairs that a cell gives for each of its rows, at most
BAND = 1.5  # largest size / smallest size in a band
BLOCK, CHUNK = 4096, 65536  # members of the smaller side, and of all, that one cell compares by sketches
BLOCK_TOKENS, CHUNK_TOKENS = 1 << 20, 1 << 23  # tokens of the smaller side, and of all, that one cell compares exactly
SLICE, SLICE_TOKENS = 256, 1 << 18  # rows compared at a time, and their tokens (or one row)
_DIGESTS = 200_000  # sets that a task remembers, to emit equal ones once
MOST = 1 << 31  # tokens of the largest set
ROUNDS = 4  # slices of hashes that are matched, and of pairs that are verified, one after the other, at most
ROUND_WORDS = 40 << 20  # words of all texts (an estimate) up to which a slice is the whole
ROUND_ROWS, ROUND_TOKENS = 1 << 21, 1 << 25  # rows, or tokens of sets, that blocks may deal in one round in any case


@dataclass(frozen=True)
class Scheme:
    """How sets emit in one band: exact and one-deletion segments."""

    band: int
    low: int
    high: int
    exact: int
    deletion: int


@dataclass(frozen=True)
class Plan:
    """Threshold num/den and all bands' schemes."""

    num: int
    den: int
    schemes: tuple[Scheme, ...]

    def differ(self, total: int) -> int:
        """Tokens in which two similar sets of ``total`` tokens together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def largest(self, n: int) -> int:
        return n * self.den // self.num

    def of(self, n: int) -> list[tuple[Scheme, int]]:
        """The schemes under which a set of n tokens emits, with the exact segments to keep."""
        least, out = -(-n * self.num // self.den), []
        for s in self.schemes:
            if s.high >= least and s.low <= n:
                partner = self.largest(n) if n <= s.high else s.high
                budget = self.differ(n + partner)
                if budget > 0:
                    out.append((s, max(0, budget - 2 * s.deletion + 1)))
        return out


def _poisson_sizes(mean: float, count: int) -> np.ndarray:
    """``count`` evenly spaced quantiles of a Poisson distribution, largest first."""
    ks = np.arange(int(mean + 10 * math.sqrt(mean + 1)) + 12)
    logs = ks * math.log(max(mean, 1e-9)) - mean - np.array([math.lgamma(k + 1) for k in ks])
    return np.searchsorted(np.cumsum(np.exp(logs)), (np.arange(count) + 0.5) / count)[::-1]


def allocate(band: int, low: int, high: int, plan: Plan, sets: float, shared: float = 0.05, check_cost: float = 0.5) -> Scheme:
    """The cheapest segments for a band with ``sets`` sets; ``shared``: chance that a token
    of one set is in an unrelated one."""
    top, n = plan.differ(high + plan.largest(high)), (low + high) / 2
    if top <= 0:
        return Scheme(band, low, high, 0, 0)
    best, found = math.inf, None
    for deletion in sorted({0, 1, 2, 4, (top + 2) // 2}):
        if deletion > (top + 2) // 2:
            continue
        need = max(0, top - 2 * deletion + 1)
        for spare in {0, 1, 2, *(math.ceil(top * x) for x in (0.1, 0.2, 0.35, 0.5))} if need else {0}:
            exact = need + spare if need else 0
            mean = n / (exact + deletion)
            keep = max(0, plan.differ(int(n) + plan.largest(int(n))) - 2 * deletion + 1)
            points = min(exact, 64)  # quantiles that stand for all segments
            used = _poisson_sizes(mean, points)[: -(-keep * points // max(exact, 1))]
            hits = keep * float(np.mean(shared**used)) if len(used) else 0.0
            hits += deletion * min(1.0, (mean + 1) * shared ** max(mean - 1, 0) + math.exp(-mean))
            cost = keep + deletion * (1 + mean) + check_cost * sets * hits
            if cost < best:
                best, found = cost, Scheme(band, low, high, exact, deletion)
    return found


def make_plan(num: int, den: int, sizes: dict[int, float], biggest: int = MOST) -> Plan:
    """``sizes``: sets by floor(log2(tokens)), an estimate; it only steers the cost."""
    plan, schemes, low = Plan(num, den, ()), [], 1
    while low <= max(biggest, 1):
        high = max(low, int(low * BAND))
        here = sizes.get(int(math.log2(low)), 0.0) * math.log2((high + 1) / low)
        schemes.append(allocate(len(schemes), low, high, plan, max(here, 1.0)))
        low = high + 1
    return Plan(num, den, tuple(schemes))


def token_sets(texts: pa.Array, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct n-gram hashes; A-Z count as lower case."""
    _, _, doc, hashes = words(utf8(texts), offs, lower=True)
    step = 0x9FB21C651E98DF25
    n = max(len(hashes) - width + 1, 0)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        grams += hashes[k : k + n] * np.uint64(pow(step, k + 1, 1 << 64))
    grams = mix(grams)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(grams[a : b - width + 1])
            if len(s) > 1:
                keep = np.empty(len(s), dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
        elif b > a:  # one token for the whole short sequence
            s = np.array([0x5851F42D4C957F2D + b - a], dtype=np.uint64)
            for w in range(a, b):
                s = mix(s * np.uint64(step) + hashes[w])
        else:
            s = np.zeros(0, dtype=np.uint64)
        out.append(s)
    return out


def signatures(tokens: np.ndarray, plan: Plan) -> np.ndarray:
    """The hashes that a set (sorted) emits."""
    out = []
    values = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D))
    sums = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    high = tokens >> np.uint64(32)
    for s, keep in plan.of(len(tokens)):
        m = s.exact + s.deletion
        if not m:
            continue
        segment = (high * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(segment, np.arange(m + 1))
        salt = mix(np.arange(m, dtype=np.uint64) + np.uint64((s.band + 1) << 32))
        whole = mix(sums[bounds[1:]] - sums[bounds[:-1]] + salt)
        size = np.diff(bounds)
        d = s.deletion  # the first segments have neighbourhoods
        if keep:
            out.append(whole[d:][np.lexsort((whole[d:], -size[d:]))[:keep]])
        if d:
            out.append(whole[:d])
            inside = segment < d
            of = segment[inside]
            out.append(mix((sums[bounds[1:]] - sums[bounds[:-1]])[of] - values[inside] + salt[of]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def sketch(tokens: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Parity of the tokens that fall on each bit of ``size`` words (a power of two): it differs in no more bits
    than the sets in tokens. A sketch's halves, one xor the other, are the sketch of half the size."""
    odd = np.bincount((tokens >> np.uint64(8) & np.uint64(64 * size - 1)).astype(np.int64), minlength=64 * size) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    if not len(tokens):
        return 0, 0
    a = mix(tokens + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    b = mix(mix(tokens) ^ np.uint64(0xE703_7ED1_A0B4_28DB)).sum(dtype=np.uint64)
    both = mix(np.array([a, b ^ np.uint64(len(tokens))], dtype=np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


SIGS = [f"sigs{k}" for k in range(ROUNDS)]
SETS = "id {id}, row long, n long, d1 long, d2 long, sk array<long>"


def _describe(docs: DataFrame, width: int, plan: Plan, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: its set's size, digest, sketch and (once per task and set) signatures, in slices of their values."""
    slices = SIGS[:rounds]
    names = ["id", "row", "n", "d1", "d2", "sk", *slices]
    edges = np.array([(1 << 64) * k // rounds for k in range(1, rounds)], dtype=np.uint64)

    def run(batches):
        seen: OrderedDict = OrderedDict()
        for batch, texts, offs in steps(batches):
            n, d1, d2, sk, sigs = [], [], [], [], [[] for _ in slices]
            for tokens in token_sets(texts, offs, width):
                digest = _digest(tokens)
                n.append(len(tokens))
                d1.append(digest[0])
                d2.append(digest[1])
                sk.append(sketch(tokens))
                if digest in seen or not len(tokens):
                    parts = [None] * rounds
                else:
                    seen[digest] = None
                    if len(seen) > _DIGESTS:
                        seen.popitem(last=False)
                    found = signatures(tokens, plan)  # ascending
                    parts = np.split(found.view(np.int64), np.searchsorted(found, edges))
                for column, part in zip(sigs, parts, strict=True):
                    column.append(part)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()),
                                              pa.array(d2, pa.int64()), pa.array(sk, longs), *(pa.array(c, longs) for c in sigs)], names)

    return docs.select("id", "row", "text").mapInArrow(run, ", ".join([SETS.format(id=dict(docs.dtypes)["id"]), *(f"{c} array<long>" for c in slices)]))


def _meetings(signed: DataFrame, path: str, rounds: int) -> DataFrame:
    """(sig, d1, low, high) of all hashes that several sets emit; ``low`` and ``high`` are two of these."""
    def matched(k: int, column: str) -> DataFrame:
        emitted = signed.where(F.col(column).isNotNull()).select("d1", F.explode(column).alias("sig"))
        shared = cut(emitted.groupBy("sig").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low != high"))
        found = stored(maybe_in(emitted, "sig", shared.select("sig")).join(shared, "sig"), f"{path}{k}")
        drop_cut(shared)
        return found

    parts = []
    for k, column in enumerate(SIGS[:rounds]):
        parts.append(matched(k, column))
        free_shuffles(signed.sparkSession, 0)
    return reduce(DataFrame.union, parts)


def _in_rounds(rows: DataFrame, key: str, rounds: int, work) -> DataFrame:
    """All that ``work`` (which stores its result) gives for ``rows``, a part of the keys after the other."""
    parts = []
    for k in range(rounds):
        parts.append(work(rows.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == k)))
        free_shuffles(rows.sparkSession, 0)
    return reduce(DataFrame.union, parts)


def _whole_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, tokens) for ``nodes`` (row, ...): read again from the texts, others filtered out before."""
    def run(batches):
        for batch, texts, offs in steps(batches):
            tokens = pa.array([t.view(np.int64) for t in token_sets(texts, offs, width)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens], ["row", "tokens"])

    return maybe_in(docs.select("row", "text"), "row", nodes).select("row", "text").mapInArrow(run, "row long, tokens array<long>")


def _verify(pairs: DataFrame, sets: DataFrame, plan: Plan, rounds: int) -> DataFrame:
    """The pairs (a, b; stored) of nodes whose whole sets are similar enough."""
    def verified(own: DataFrame) -> DataFrame:
        a, b = (maybe_in(sets.select(F.col("node").alias(end), F.col("tokens").alias(f"t{end}")), end, own.select(end)) for end in ("a", "b"))
        both = F.size(F.array_intersect("ta", "tb")).cast("long")
        return cut(own.join(a, "a").join(b, "b").where(
            plan.den * both >= plan.num * (F.size("ta").cast("long") + F.size("tb").cast("long") - both)).select("a", "b"))

    return _in_rounds(pairs, "b", rounds, verified)


def _near(a: str, b: str, plan: Plan):
    """An exact filter on (n, sk) of two nodes: sizes fit, and the sketches differ in few enough bits."""
    total = F.col(f"{a}n") + F.col(f"{b}n")
    bits = sum((F.bit_count(F.col(f"{a}sk")[i].bitwiseXOR(F.col(f"{b}sk")[i])) for i in range(1, SKETCH)),
               F.bit_count(F.col(f"{a}sk")[0].bitwiseXOR(F.col(f"{b}sk")[0])))
    fits = (plan.den * F.least(f"{a}n", f"{b}n") >= plan.num * F.greatest(f"{a}n", f"{b}n"))
    return fits & (bits * (plan.den + plan.num) <= total * (plan.den - plan.num))


def _deal(rows: DataFrame, group: str, few, columns: list[str]) -> DataFrame:
    """``rows`` dealt to cells of a group, sorted by cell: kind 0 are the ``few``, each in one block
    and all chunks, kind 1 are all rows, each in one chunk and all blocks; of blocks only those in ``here``."""
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    cell = (F.col("__block").cast("long") * F.col("chunks") + F.col("__chunk")).alias("cell")
    one = rows.where(few).withColumn("__block", own(F.col("blocks"), 1)).where(F.array_contains("here", F.col("__block")))
    one = one.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(group, cell, F.lit(0).alias("kind"), *columns)
    every = rows.withColumn("__chunk", own(F.col("chunks"), 2)).withColumn("__block", F.explode("here")).select(group, cell, F.lit(1).alias("kind"), *columns)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: small rows cost much work, so tasks are not to be coalesced
    return one.union(every).repartition(tasks, group, "cell").sortWithinPartitions(group, "cell", "kind")


def _by_blocks(size: DataFrame, group: str, least: int, work) -> DataFrame:
    """All that ``work`` gives for the groups of ``size`` (total, most, blocks, chunks; stored), some blocks after the others.

    Each block meets its whole group, so a large group's rows are dealt as often as it has blocks; a round deals
    about twice all groups' rows, or ``least``. ``work`` gets the groups with their blocks in ``here``."""
    dealt, own = size.agg(F.sum(F.col("total") * F.col("blocks") + (F.col("total") - F.col("most")) * F.col("chunks")), F.sum("total")).first()
    rounds, parts = max(1, math.ceil((dealt or 0) / max(2 * (own or 0), least))), []
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    for k in range(rounds):
        here = size.withColumn("here", F.filter(every, lambda b, k=k: F.pmod(F.xxhash64(group, b), F.lit(rounds)) == k) if rounds > 1 else every)
        parts.append(cut(work(here.where(F.size("here") > 0))))
        if rounds > 1:
            free_shuffles(size.sparkSession, 0)
    return reduce(DataFrame.union, parts)


def _cells(batches):
    """(held, part) of the Arrow batches of dealt rows: the rows of kind 0 of a cell, as a list of
    record batches that is the same object for the whole cell, and a slice of its rows of kind 1."""
    try:
        yield from _cell_slices(batches)
    finally:
        give_back()


def _cell_slices(batches):
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        group, cell, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        edges = np.flatnonzero((group[1:] != group[:-1]) | (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
        for s, e in zip([0, *edges], [*edges, len(group)], strict=True):
            if (group[s], cell[s]) != key:
                key, held = (group[s], cell[s]), []
            part = batch.slice(s, e - s)
            if kind[s] == 0:
                held.append(part)
            elif held:  # a block may have got no member of the smaller side
                for at in range(0, e - s, SLICE):
                    yield held, part.slice(at, SLICE)


def _by_tokens(part: pa.RecordBatch):
    """Lists of one slice each of dealt sets, with at most ``SLICE_TOKENS`` tokens (or one set)."""
    reach = np.cumsum(part.column(5).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(reach):
        end = max(at + 1, int(np.searchsorted(reach, done + SLICE_TOKENS, side="right")))
        yield [part.slice(at, end - at)]
        at, done = end, int(reach[end - 1])


def _links_batch(a, b) -> pa.RecordBatch:
    a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _suspects(live: DataFrame, plan: Plan, words: int = SKETCH) -> DataFrame:
    """(a, b, alone): the pairs across components that sizes and sketches cannot rule out, where they are at most ``FEW``
    for each row that meets a block (``alone``), else a forest whose trees hold them.

    ``live``: sig, node, n, sk (of ``words`` words), component. In each group that spans several components the
    largest one stays whole; the others' members are dealt to blocks, all members to chunks,
    and each block meets each chunk in a task of its own, the chunk streaming past the block."""
    counts = live.groupBy("sig", "component").count()
    groups = counts.groupBy("sig").agg(F.max_by("component", "count").alias("main"), F.sum("count").alias("total"),
                                       F.max("count").alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1")
    size = cut(groups.select("sig", "main", "total", "most", F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("total") / CHUNK).cast("int").alias("chunks")))
    num, den = plan.num, plan.den

    def columns(parts):
        node, n, comp = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (3, 4, 6))
        return node, n, comp, np.concatenate([np.asarray(p.column(5).flatten()) for p in parts]).astype(np.int64).view(np.uint64).reshape(-1, words)

    def given(a, b, alone: bool) -> pa.RecordBatch:
        links = _links_batch(a, b)
        return links.append_column("alone", pa.array(np.full(links.num_rows, alone)))

    def run(batches):
        last = None
        for held, part in _cells(batches):
            if held is not last:
                last, mine = held, columns(held)
                tree = np.arange(len(mine[0]))
            node, n, comp, sk = columns([part])
            total = mine[1][None, :] + n[:, None]
            ok = (mine[2][None, :] != comp[:, None]) & (den * np.minimum(mine[1][None, :], n[:, None]) >= num * np.maximum(mine[1][None, :], n[:, None]))
            if not ok.any():
                continue
            bits = np.zeros(total.shape, dtype=np.int16)
            for k in range(words):
                bits += np.bitwise_count(mine[3][None, :, k] ^ sk[:, None, k])
            ok &= bits <= total * (den - num) // (den + num)
            if np.count_nonzero(ok) <= FEW * len(node):
                i, j = np.nonzero(ok)
                yield given(node[i], mine[0][j], True)
                continue
            links = []
            for i in np.flatnonzero(ok.any(axis=1)).tolist():
                trees, at = np.unique(tree[ok[i]], return_index=True)
                links += [(int(node[i]), int(mine[0][j])) for j in np.flatnonzero(ok[i])[at]]
                if len(trees) > 1:
                    tree[np.isin(tree, trees)] = trees[0]
            yield given(*zip(*links, strict=True), False)

    def compared(here: DataFrame) -> DataFrame:
        dealt = _deal(live.join(here, "sig"), "sig", F.col("component") != F.col("main"), ["node", "n", "sk", "component"])
        return dealt.mapInArrow(run, "a long, b long, alone boolean").distinct()

    return _by_blocks(size, "sig", ROUND_ROWS, compared)


def _sketches(whole: DataFrame, nodes: DataFrame, words: int | None = None) -> DataFrame:
    """(node, sk) of (at least) the ``nodes``: sketches of ``words`` words, or as many bits as the set has tokens."""
    def run(batches):
        for batch in batches:
            tokens, sk = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64), []
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
            for at, end in zip([0, *ends], ends):
                sk.append(sketch(tokens[at:end], words or max(SKETCH, 1 << (-(-(end - at) // 64) - 1).bit_length())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sk, pa.list_(pa.int64()))], ["node", "sk"])
        give_back()

    return maybe_in(whole, "node", nodes).select("node", "tokens").mapInArrow(run, "node long, sk array<long>")


def _likely(pairs: DataFrame, nodes: DataFrame, whole: DataFrame, plan: Plan) -> DataFrame:
    """The ``pairs`` (a, b; stored) that sketches as long as their sets cannot rule out."""
    num, den = plan.num, plan.den
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = cut(_sketches(whole, ends).join(ends, "node", "left_semi").join(nodes.select("node", "n"), "node"))
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("sk").alias(f"{x}sk")) for x in "ab")

    def run(batches):
        for batch in batches:
            total = batch.column(2).to_numpy(zero_copy_only=False) + batch.column(3).to_numpy(zero_copy_only=False)
            sizes, keep = [batch.column(i).value_lengths().to_numpy(zero_copy_only=False) for i in (4, 5)], np.zeros(len(total), dtype=bool)
            for both in np.unique(np.stack(sizes), axis=1).T:
                at = np.flatnonzero((sizes[0] == both[0]) & (sizes[1] == both[1]))
                x, y = (batch.column(i).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(at), -1) for i in (4, 5))
                while x.shape[1] != y.shape[1]:
                    x, y = (z[:, : z.shape[1] // 2] ^ z[:, z.shape[1] // 2 :] if z.shape[1] > min(x.shape[1], y.shape[1]) else z for z in (x, y))
                keep[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= total[at] * (den - num) // (den + num)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])
        give_back()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "an", "bn", "ask", "bsk").mapInArrow(run, "a long, b long")


def _narrowed(suspects: DataFrame, nodes: DataFrame, whole: DataFrame, plan: Plan) -> DataFrame:
    """(a, b) for ``suspects`` (a, b, alone): the trees of those that are not alone are compared by longer sketches,
    pairs by sketches as long as their sets; what these cannot rule out stays.

    ``nodes``: node, component, n."""
    pairs, trees = suspects.where("alone").select("a", "b"), suspects.where("NOT alone").select("a", "b")
    forests = []
    if not trees.isEmpty():
        members = cut(components(trees).select("node", F.col("component").alias("sig")).join(nodes, "node"))
        live = cut(members.join(_sketches(whole, members.select("node"), LONG), "node").select("sig", "node", "n", "sk", "component"))
        again = _suspects(live, plan, LONG)
        drop_cut(live)
        pairs = pairs.union(again.where("alone").select("a", "b"))
        forests = [again.where("NOT alone").select("a", "b")]
    return reduce(DataFrame.union, [cut(_likely(cut(pairs.distinct()), nodes, whole, plan)), *forests])


def _across(suspects: DataFrame, nodes: DataFrame, whole: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) across components, verified on the whole sets: all pairs of a tree of
    ``suspects`` are compared, and each cell gives a forest of its links.

    ``nodes``: node, component, n. A group is a tree; its largest component stays whole, and
    blocks and chunks are bounded in tokens. Sets are compared through an index from the
    block's tokens to its sets, which counts the shared tokens of a set with all of them."""
    groups = components(suspects).select("node", F.col("component").alias("tree"))
    members = cut(groups.join(nodes, "node"))
    counts = members.groupBy("tree", "component").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("tokens"))
    size = counts.groupBy("tree").agg(F.max_by("component", "count").alias("main"), F.max_by("tokens", "count").alias("most"),
                                      F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("k")).where("k > 1")
    size = size.select("tree", "main", "total", "most", F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("most")) / BLOCK_TOKENS)).cast("int").alias("blocks"),
                       F.greatest(F.lit(1), F.ceil(F.col("total") / CHUNK_TOKENS)).cast("int").alias("chunks"))
    size = cut(size)
    num, den = plan.num, plan.den

    def sets(parts):
        node, comp = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (3, 4))
        n = np.concatenate([p.column(5).value_lengths().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
        return node, comp, n, np.concatenate([p.column(5).flatten().to_numpy(zero_copy_only=False) for p in parts])

    def run(batches):
        last = None
        for held, part in _cells(batches):
            if held is not last:
                last, (mine, mine_comp, mine_n, tokens) = held, sets(held)
                order = np.argsort(tokens, kind="stable")
                index, of = tokens[order], np.repeat(np.arange(len(mine)), mine_n)[order]
                joined: dict[int, int] = {}
                mine_comp = mine_comp.copy()
            links = []
            for node, comp, n, tokens in map(sets, _by_tokens(part)):
                low, high, at = np.searchsorted(index, tokens, "left"), np.searchsorted(index, tokens, "right"), 0
                for i in range(len(node)):
                    lo, hi = low[at : at + n[i]], high[at : at + n[i]]
                    at += n[i]
                    own = int(comp[i])
                    while own in joined:
                        own = joined[own]
                    width = hi - lo
                    reach = np.cumsum(width)
                    if not len(reach) or not reach[-1]:
                        continue
                    found = of[np.repeat(lo - reach + width, width) + np.arange(reach[-1])]
                    both = np.bincount(found, minlength=len(mine))
                    ok = (mine_comp != own) & (den * both >= num * (mine_n + n[i] - both))
                    if ok.any():
                        here = np.flatnonzero(ok)
                        others, first = np.unique(mine_comp[here], return_index=True)
                        links += [(int(node[i]), int(mine[j])) for j in here[first]]
                        joined.update((c, own) for c in others.tolist())
                        mine_comp[np.isin(mine_comp, others)] = own
            if links:
                yield _links_batch(*zip(*links, strict=True))

    def compared(here: DataFrame) -> DataFrame:
        chosen = cut(members.select("tree", "node", "component").join(here, "tree"))
        rows = chosen.join(maybe_in(whole, "node", chosen.select("node")), "node")
        dealt = _deal(rows, "tree", F.col("component") != F.col("main"), ["node", "component", "tokens"])
        return dealt.mapInArrow(run, "a long, b long").distinct()

    return _by_blocks(size, "tree", ROUND_TOKENS, compared)


def estimate_sizes(docs: DataFrame) -> dict[int, float]:
    """Sets by floor(log2(words)), taken as a sixth of the bytes: an estimate that steers the cost only."""
    found = docs.select(F.floor(F.log2(F.greatest(F.octet_length("text") / 6, F.lit(1)))).cast("int").alias("k")).groupBy("k").count().collect()
    return {r["k"]: float(r["count"]) for r in found}


def rounds_for(sizes: dict[int, float]) -> int:
    """Rounds that sets of these sizes take: as many as keep a round's hashes few, within ``ROUNDS``."""
    words = sum(1.5 * 2**k * count for k, count in sizes.items())
    return min(ROUNDS, max(1, math.ceil(words / ROUND_WORDS)))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: id, row, n_shingles, component_id, first (one row per component).

    Two documents link when den * intersection >= num * union of their n-gram sets.
    ``docs`` is a stored table; ``row`` is the row's number in it (`number_rows`)."""
    spark = docs.sparkSession
    docs = number_rows(docs.select(docs[id_col].alias("id"), not_null_text(text_col).alias("text")), "row")
    sizes = estimate_sizes(docs)
    plan, rounds = make_plan(num, den, sizes), rounds_for(sizes)
    with scratch(spark) as path:
        signed = stored(_describe(docs, width, plan, rounds), f"{path}/signed")
        sets = stored(signed.drop(*SIGS), f"{path}/sets")
        nodes = cut(sets.where("n > 0").groupBy("d1", "d2").agg(
            F.min("row").alias("node"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"),
            F.first("n").alias("n"), F.first("sk").alias("sk")))
        met = _meetings(signed, f"{path}/met", rounds)
        delete_path(spark, f"{path}/signed")
        who = nodes.select("d1", "node", "n", "sk")
        star = met.select("d1", F.explode(F.array("low", "high")).alias("p1")).where("d1 != p1").distinct()
        pivot = who.select(F.col("d1").alias("p1"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("sk").alias("bsk"))
        member = who.select("d1", F.col("node").alias("a"), F.col("n").alias("an"), F.col("sk").alias("ask"))
        pairs = star.join(member, "d1").join(pivot, "p1").where(_near("a", "b", plan)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = cut(pairs)
        live_nodes = cut(met.select("d1").distinct().join(who, "d1").select(F.col("node").alias("row")))
        whole = _whole_sets(docs, live_nodes, width).join(live_nodes, "row", "left_semi").select(F.col("row").alias("node"), "tokens")
        whole = stored(whole, f"{path}/whole")
        links = _verify(pairs, whole, plan, rounds)
        first = cut(components(links))
        live = met.select("sig", "d1").distinct().join(who, "d1").join(first, "node", "left").select(
            "sig", "node", "n", "sk", F.coalesce("component", "node").alias("component"))
        suspects = _in_rounds(stored(live, f"{path}/live"), "sig", rounds, lambda own: _suspects(own, plan))
        delete_path(spark, f"{path}/live")
        more = who.select("node", "n").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
        more = cut(more)
        more = _across(_narrowed(suspects, more, whole, plan), more, whole, plan)
        label = lambda end: more.join(first.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        more = label("a")
        more = label("b")
        top = components(more)  # of components
        top = top.select(F.col("node").alias("component"), F.col("component").alias("final"))
        ends = nodes.select("d1", "d2", "node", "best").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
        ends = ends.join(top, "component", "left").withColumn("component", F.coalesce("final", "component")).drop("final")
        least = ends.groupBy("component").agg(F.min("best").alias("least"))
        named = ends.join(least, "component").select("d1", "d2", F.col("least.id").alias("component_id"), F.col("least.row").alias("first_row"))
        named = cut(named)  # read from storage, so that the join below is free to split a hot digest
        return cut(sets.select("id", "row", "n", "d1", "d2").join(named, ["d1", "d2"], "left").select(
            "id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
            ((F.col("n") == 0) | (F.col("row") == F.col("first_row"))).alias("first")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of similar texts, with all its columns: that with the smallest id."""
    stay = similar_groups(docs, id_col, text_col, width, num, den).where("first").select(F.col("row").alias("__row"))
    return number_rows(docs, "__row").join(stay, "__row", "left_semi").drop("__row")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS g
      FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b USING (g) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
         WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

"""N-gram Jaccard join by token-combination prefixes.

Documents with equal shingle sets are one class; only classes are joined. Tokens (shingle hashes) fall into classes by
how many sets they were counted in: rare ones are indexed by themselves, frequent ones by pairs and very frequent ones
by triples. Tokens have one global order, rare ones first, by hash within a class. A set of n tokens of which a partner
must hold ceil(T n / 100) can miss so many that a prefix is extended until each choice of that many missing tokens
leaves a rare token or a combination: m tokens of a class of k-combinations stand for m - k + 1 of them. So that
large sets don't give all pairs of their prefix, frequent classes are dealt by hash into subclasses, whose number
follows the size (by bands of sizes, of which a set serves those of its possible partners), and tokens are combined
within a subclass only. Of two sets that link, the shorter prefix holds a whole combination of shared tokens, and the
longer prefix holds it too.

Sets that meet are not paired all with all. In each bucket (sets with one signature) every set is paired with
the smallest class first; those pairs are pruned by size and by parity sketches (a bit per cell tells whether an odd
number of tokens falls there; differing bits bound the symmetric difference from below), each set keeps the pair
with the most shared signatures for a first check of the whole sets, and further pairs are checked only where the two
are still in different components. Buckets that hold several components afterwards are compared within, by
array arithmetic on sketches, large ones in blocks: only pairs of different components, and of the largest component
only against the others. Of the pairs that could link, those that connect the components (the most alike first) are checked
before; all others only where their components are still different. So each pair of sets that links is checked on the whole sets or is already connected.

Token counts only choose the order, on which exactness does not depend: the broadcast table of frequent tokens
is bounded by raising the count from which a token is frequent.

Defined results: null and empty texts (and texts without words) have no shingles and link with nothing; texts
of fewer words than the width are one shingle; rows that share an id share its class; an empty table gives an
empty result. Thresholds of 50 % or less are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, by_bytes, release, table, text_of, trim
from .words import combine, mix, shingles, slices, word_hashes

#: A token is frequent from this count on, or from the power of two that keeps the table within MOST_FREQUENT, and very
#: frequent from VERY times that.
FREQUENT, MOST_FREQUENT, VERY = 32, 1_000_000, 32
#: Bits of the table of tokens met more than once.
ACTIVE_BITS = 26
#: Up to this size a set's frequent tokens are one class of pairs, beyond it they are dealt into subclasses.
PAIRS_UP_TO = 60
#: Members of a bucket that are compared at once, pairs that are looked at at once, and bytes of counts in one group.
BLOCK, AT_ONCE, GROUP_BYTES = 512, 100_000, 32_000_000


def counted_share(percent: int) -> float:
    """The share of each set, by hash, in which tokens are counted: the prefix, as much again by which a partner may rank
    a token later, and a quarter more for prefixes that frequent tokens stretch."""
    return min(1.0, 2.5 * (100 - percent) / percent)


def need(size, percent: int):
    """ceil(percent * size / 100)."""
    return -(-percent * size // 100)


def sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with their sets, by lots of a bounded size of texts."""
    for batch in batches:
        at = 0
        for texts in slices(batch.column(1)):
            bounds, word = word_hashes(texts)
            yield batch.slice(at, len(texts)), [shingles(word[a:b], width) for a, b in zip(bounds, bounds[1:], strict=False)]
            at += len(texts)
    trim()


def class_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def spread(tokens: np.ndarray) -> np.ndarray:
    """Another hash of tokens: prefixes hold the smallest tokens, so parts can't be ranges of the tokens themselves."""
    return mix(tokens + np.uint64(0x9E3779B97F4A7C15))


def sketch(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Parity of the number of tokens in each cell, a power of two of cells, at least about 9 for each token that two sets
    that link may differ in."""
    words = 1 << max(0, int(max(0, len(tokens) * min(100, 5 * (100 - percent)) // 100 - 1)).bit_length() - 6)
    cell = mix(tokens) & np.uint64(words * 64 - 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    return out


class Sketches:
    """Sketches of a lot of sets, compared by pairs."""

    def __init__(self, raw: list[bytes], size: np.ndarray, percent: int):
        self.flat = np.frombuffer(b"".join(raw), np.uint64)
        self.words = np.array([len(x) // 8 for x in raw], np.int64)
        self.start = np.cumsum(self.words) - self.words
        self.size, self.percent = size.astype(np.int64), percent

    def _of(self, rows: np.ndarray, words: int, to: int) -> np.ndarray:
        found = self.flat[self.start[rows][:, None] + np.arange(words)]
        while found.shape[1] > to:  # cells that share their lower bits are one cell of the smaller sketch
            half = found.shape[1] // 2
            found = found[:, :half] ^ found[:, half:]
        return found

    def could_link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether 100 |A and B| >= percent |A or B| is possible by sizes and sketches, and the share of differing bits. With
        d tokens in one set alone that is d (100 + percent) <= (100 - percent) (|A| + |B|)."""
        share = np.zeros(len(a))
        p, total = self.percent, self.size[a] + self.size[b]
        ok = 100 * np.minimum(self.size[a], self.size[b]) >= p * np.maximum(self.size[a], self.size[b])
        wide = self.words[a] * (1 << 20) + self.words[b]
        for w in np.unique(wide[ok]):
            x, y = int(w) >> 20, int(w) & ((1 << 20) - 1)
            every = np.flatnonzero(ok & (wide == w))
            for k in range(0, len(every), step := max(1, 4_000_000 // max(x, y))):
                at = every[k : k + step]
                differ = np.bitwise_count(self._of(a[at], x, min(x, y)) ^ self._of(b[at], y, min(x, y))).sum(axis=1, dtype=np.int64)
                ok[at] = differ * (100 + p) <= (100 - p) * total[at]
                share[at] = differ / total[at]
        return ok, share


def _count(docs: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """Counts of tokens in the lowest part of each set, by range of hash: per range the frequent tokens with their
    counts, and the cells of the table of active tokens."""
    span, share = np.uint64(2**64 // parts + 1), counted_share(percent)

    def emit(batches):
        for _, sets in sets_of(batches, width):
            own = [s[: int(np.ceil(share * len(s)))] for s in sets]
            tokens, counts = np.unique(np.concatenate(own), return_counts=True)
            place = spread(tokens)
            order = np.argsort(place)
            tokens, counts, place = tokens[order], counts[order], place[order]
            cut = np.searchsorted(place, np.arange(1, parts, dtype=np.uint64) * span)
            for k, (t, c) in enumerate(zip(np.split(tokens, cut), np.split(counts.astype(np.uint32), cut), strict=True)):
                if len(t):
                    yield k, t.tobytes(), c.tobytes()

    def rows(batches):
        out = list(emit(batches))
        for k in range(0, len(out), 500):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 500], strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "tokens", "counts"])

    def add(key, group):
        t = np.frombuffer(b"".join(group.column("tokens").to_pylist()), np.uint64)
        c = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint32)
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        t, c = t[first], np.add.reduceat(c.astype(np.int64), first)
        often = c >= FREQUENT
        active = np.unique((spread(t[c > 1]) >> np.uint64(64 - ACTIVE_BITS)).astype(np.int64))
        cells = np.bitwise_or.reduceat(np.int64(1) << (active & 63), w := np.flatnonzero(np.diff(active >> 6, prepend=-1))) if len(active) else active
        words = active[w] >> 6 if len(active) else active
        n, m = int(often.sum()), len(words)
        return pa.table({"kind": pa.array([0] * n + [1] * m, pa.int32()), "key": pa.array(np.concatenate([t[often].view(np.int64), words])), "value": pa.array(np.concatenate([c[often], cells]))})

    return docs.mapInArrow(rows, "part int, tokens binary, counts binary").groupBy("part").applyInArrow(add, "kind int, key long, value long")


def combined(tokens: np.ndarray, of: np.ndarray, k: int) -> list[np.ndarray]:
    """All combinations of k (2 or 3) tokens within a subclass, each hashed."""
    order = np.argsort(of, kind="stable")
    t, g, out = tokens[order], of[order], []
    for i in range(1, len(t)):
        two = np.flatnonzero(g[:-i] == g[i:])
        if not len(two):
            break
        pair = combine(t[two], t[two + i])
        if k == 2:
            out.append(pair)
            continue
        for j in range(i + 1, len(t)):
            there = two + j < len(t)
            three = there & (g[two] == g[np.minimum(two + j, len(t) - 1)])
            if not three.any():
                break
            out.append(combine(pair[three], t[two[three] + j]))
    return out


class Order:
    """The global order of tokens, their classes, and what may be left out of the index."""

    def __init__(self, frequent: np.ndarray, k: np.ndarray, active: np.ndarray, percent: int):
        self.frequent, self.k, self.active, self.percent = frequent, k, active, percent
        self.up_to = max(3, PAIRS_UP_TO)

    def kinds(self, s: np.ndarray) -> np.ndarray:
        """How many tokens are combined in the class of each token."""
        if not len(self.frequent):
            return np.ones(len(s), np.int8)
        at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
        return np.where(self.frequent[at] == s, self.k[at], np.int8(1))

    def band(self, n: int) -> int:
        return 0 if n <= self.up_to else (n // (self.up_to + 1)).bit_length()

    def subclasses(self, band: int) -> tuple[int, int]:
        """Numbers of subclasses of pairs and of triples (0: these are combined as pairs, too) for sets of a band. They stay
        below what sets of the band must share, so that whole sets are always prefix enough."""
        if band == 0:
            return 1, 0
        share = need((self.up_to + 1) << (band - 1), self.percent)
        return max(1, share // 5), share // 8

    def signatures(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        share = need(n, self.percent)
        want = n - share + 1
        kind = self.kinds(s[: 2 * want + 16])
        if len(kind) < n and (kind == 1).sum() < want:
            kind = self.kinds(s)
        rare = np.flatnonzero(kind == 1)[:want]
        # A partner ranks a shared token at most its own extra tokens later; up to there both have counted it.
        sure = rare < (counted_share(self.percent) - (100 - self.percent) / self.percent) * n * self.percent / 100
        token = s[rare]
        cell = (spread(token) >> np.uint64(64 - ACTIVE_BITS)).astype(np.int64)
        alone = sure & ((self.active[cell >> 6] >> (cell & 63)) & 1 == 0)
        out = [token[~alone]]
        if len(rare) < want:
            for band in range(self.band(share), self.band(n) + 1):
                out += self._of_band(s, kind, want - len(rare), band)
        return np.concatenate(out)

    def _of_band(self, s: np.ndarray, kind: np.ndarray, left: int, band: int) -> list[np.ndarray]:
        two, three = self.subclasses(band)
        out = []
        for k, count, tokens in ((2, two, s[kind == 2] if three else s[kind > 1]), (3, three, s[kind == 3] if three else s[:0])):
            if not len(tokens):
                continue
            of = (mix(tokens ^ np.uint64(0xA5A5)) % np.uint64(count)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            first = np.flatnonzero(np.diff(of[order], prepend=-1))
            rank = np.empty(len(of), np.int64)
            rank[order] = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
            sure = np.cumsum(rank >= k - 1)
            stop = int(np.searchsorted(sure, left)) + 1
            out += [combine(x, np.uint64(band * 4 + k)) for x in combined(tokens[:stop], of[:stop], k)]
            left -= int(sure[min(stop, len(of)) - 1])
            if left <= 0:
                break
        return out


_ROWS = [("kind", pa.int32()), ("doc_id", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("sig", pa.int64()), ("sketch", pa.binary())]


def _index(docs: DataFrame, width: int, order) -> DataFrame:
    """Kind 0: a row for each document with its class, the class's size and once a lot its sketch; kind 1: the signatures of
    each class (once a lot)."""

    def fn(batches):
        for rows, sets in sets_of(batches, width):
            names, sketches, seen, sigs = [], [], {}, []
            for s in sets:
                name = class_of(s) if len(s) else None
                new = name is not None and name not in seen
                names.append(name)
                sketches.append(sketch(s, order.value.percent).tobytes() if new else None)
                if new:
                    seen[name] = len(s)
                    sigs.append(order.value.signatures(s) if len(s) > 1 else s[:0])
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), none.cast(pa.int64()), pa.array(sketches, pa.binary())], [c for c, _ in _ROWS])
            if not sigs:
                continue
            sig, owner = np.concatenate(sigs).view(np.int64), np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
            own, size = pa.array(list(seen), pa.binary()), np.array(list(seen.values()), np.int64)
            for k in range(0, len(sig), 20_000):
                o = owner[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(o), np.int32)), pa.nulls(len(o), pa.int64()), pa.nulls(len(o), pa.int64()), pa.array(size[o]), own.take(pa.array(o)), pa.array(sig[k : k + 20_000]), pa.nulls(len(o), pa.binary())], [c for c, _ in _ROWS])

    return docs.mapInArrow(fn, "kind int, doc_id long, print long, n long, class binary, sig long, sketch binary")


def _pruned(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, weight) whose sketches let them link."""
    of = lambda c: sketches.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "weight", "na", "nb", "sa", "sb")

    def fn(batches):
        for g in batches:
            n = g.num_rows
            known = Sketches(g.column(5).to_pylist() + g.column(6).to_pylist(), np.concatenate([g.column(3).to_numpy(), g.column(4).to_numpy()]), percent)
            yield g.select([0, 1, 2]).filter(pa.array(known.could_link(np.arange(n), np.arange(n) + n)[0]))

    return both.mapInArrow(fn, "a binary, b binary, weight long")


def _pairs_within(runs: np.ndarray, own: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one run (runs: where each begins, and the end): all of a run if i is j, else block i against j."""
    if i != j:
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for k in range(0, len(left), step := max(1, AT_ONCE // max(1, len(right)))):
            some = left[k : k + step]
            yield np.repeat(some, len(right)), np.tile(right, len(some))
        return
    length = np.diff(runs)
    for n in np.unique(length[length > 1]):
        x, y = np.triu_indices(n, 1)
        starts = runs[:-1][length == n]
        for k in range(0, len(starts), step := max(1, AT_ONCE // len(x))):
            s = starts[k : k + step, None]
            yield (s + x).ravel(), (s + y).ravel()


def _forest(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of pairs of root numbers those that join all that the pairs join, the most alike first."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    keep = []
    order = np.argsort(share, kind="stable")
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, np.int64)


def _within(members: DataFrame, sketches: DataFrame, percent: int, parts: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of members (sig, class, n, root) of one bucket but of different roots that could link. Small buckets
    are compared many at a time; a larger one is dealt into blocks, by whether a member is of the bucket's most common
    root, and each pair of blocks is compared by itself, but those of two blocks of that root. With forest, of the pairs
    found together only those that connect their roots are given, and rows without a pair name the buckets (sig) that
    hold any."""
    roots = members.groupBy("sig", "root").agg(F.count("*").alias("m"))
    most = roots.groupBy("sig").agg(F.sum("m").alias("m"), F.max("m").alias("x"), F.max_by("root", "m").alias("top")).select(F.col("sig").alias("of"), "m", "x", "top")
    dealt = members.join(most, F.col("sig") == F.col("of")).drop("of")
    small = dealt.where(F.col("m") <= BLOCK).select(F.pmod(F.xxhash64("sig"), F.lit(parts)).alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "sig", "class", "n", "root")
    minor = F.ceil((F.col("m") - F.col("x")) / BLOCK).cast("int")
    major = F.ceil(F.col("x") / BLOCK).cast("int")
    large = dealt.where(F.col("m") > BLOCK).withColumns({"a": minor, "b": major, "top": F.col("root") == F.col("top")}).where("a > 0")
    own = F.when(F.col("top"), F.col("a") + F.pmod(F.xxhash64("class"), F.col("b"))).otherwise(F.pmod(F.xxhash64("class"), F.col("a"))).cast("int")
    # Blocks of the most common root meet the others only; these meet every block.
    large = large.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("top"), F.col("a")).otherwise(F.col("a") + F.col("b")) - 1)))
    large = large.select(F.col("sig").alias("key"), F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "sig", "class", "n", "root")

    def fn(key, group):
        sig = group.column("sig").to_numpy()
        group = group.take(pa.array(np.argsort(sig, kind="stable"))).combine_chunks()
        sig, own = group.column("sig").to_numpy(), group.column("own").to_numpy()
        names, (i, j) = group.column("class").to_pylist(), (key[1].as_py(), key[2].as_py())
        known = Sketches(group.column("sketch").to_pylist(), group.column("n").to_numpy(), percent)
        _, root = np.unique(np.frombuffer(b"".join(group.column("root").to_pylist()), np.uint64).reshape(-1, 2), axis=0, return_inverse=True)
        root = root.ravel()
        found, held, lot = set(), set(), [np.zeros((4, 0))]
        for a, b in _pairs_within(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]])), own, i, j):
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            ok, share = known.could_link(a, b)
            a, b, share = a[ok], b[ok], share[ok]
            if not forest:
                found.update((min(names[x], names[y]), max(names[x], names[y])) for x, y in zip(a, b, strict=True))
            elif len(a):
                held.update(np.unique(sig[a]).tolist())
                both = np.concatenate([lot[-1], np.stack([root[a], root[b], a, b]).astype(np.float64)], axis=1)
                shares = np.concatenate([shares, share]) if lot[-1].shape[1] else share
                keep = _forest(both[0].astype(np.int64), both[1].astype(np.int64), shares)
                lot, shares = [both[:, keep]], shares[keep]
        for x, y in lot[-1][2:].astype(np.int64).T.tolist():
            found.add((min(names[x], names[y]), max(names[x], names[y])))
        n, m = len(found), len(held)
        return pa.table({"a": pa.array([p for p, _ in found] + [None] * m, pa.binary()), "b": pa.array([q for _, q in found] + [None] * m, pa.binary()), "sig": pa.array([None] * n + sorted(held), pa.int64())})

    rows = small.unionByName(large).join(sketches.select(F.col("class").alias("c"), "sketch"), F.col("class") == F.col("c")).drop("c")
    return rows.groupBy("key", "i", "j").applyInArrow(fn, "a binary, b binary, sig long")


def verify(steps: Steps, docs: DataFrame, first: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose whole sets link. Only the texts of each class's first document are read on,
    told by a bit table of fixed size; the sets of others that it lets pass meet no pair."""
    names = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 23))
    rows = first.join(names, "class", "left_semi").groupBy(F.shiftright(bit("first"), 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit("first") % 64).cast("int"))).alias("v")).collect()  # at most 131,072
    known = docs.sparkSession.createDataFrame([(int(r[0]), int(r[1])) for r in rows], "w long, v long")
    id_col, text_col = docs.columns[:2]
    some = docs.withColumn("w", F.shiftright(bit(id_col), 6)).join(F.broadcast(known), "w")
    some = some.where(F.call_function("shiftright", F.col("v"), (bit(id_col) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1).select(id_col, text_col)

    def fn(batches):
        seen = set()
        for _, sets in sets_of(batches, width):
            found = {name: s for s in sets if len(s) and (name := class_of(s)) not in seen}
            seen.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["class", "tokens"])

    sets = steps.write(some.mapInArrow(fn, "class binary, tokens binary"), "sets")
    n = sets.agg(F.count("*"), F.countDistinct("class")).first()
    whole = sets if n[0] == n[1] else sets.dropDuplicates(["class"])  # rows with one id and text in several tasks
    both = pairs.select("a", "b").join(whole.select(F.col("class").alias("b"), F.col("tokens").alias("y")), "b").join(whole.select(F.col("class").alias("a"), F.col("tokens").alias("x")), "a").select("a", "b", "x", "y")

    def check(batches):
        for g in batches:
            keep = []
            for x, y in zip(g.column(2), g.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield g.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = steps.write(both.mapInArrow(check, "a binary, b binary"), "links")
    steps.drop(sets)
    release(docs.sparkSession)
    return links


def components(steps: Steps, links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: the smallest node reachable. Alternates large-star and small-star steps until no
    edge changes; each step's edges are written and reread."""
    edges = steps.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    known = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = known()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        after = steps.write(small, "edges")
        steps.drop(edges)
        edges = after
        state = known()
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = state


def _roots(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """pairs(a, b, ..) with the roots of both: ra, rb."""
    of = lambda c: root.select(F.col("node").alias(f"{c}_"), F.col("root").alias(f"{c}_root"))
    both = pairs.join(of("a"), F.col("a") == F.col("a_"), "left").join(of("b"), F.col("b") == F.col("b_"), "left")
    return both.withColumns({"ra": F.coalesce("a_root", "a"), "rb": F.coalesce("b_root", "b")}).drop("a_", "b_", "a_root", "b_root")


def _merge(steps: Steps, root: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) with further links: only roots are joined anew, not all links."""
    edges = _roots(links, root).select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct()
    new = steps.write(components(steps, edges), "roots").select(F.col("node").alias("n"), F.col("root").alias("r"))
    moved = root.join(new, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root"))
    return steps.write(moved.unionByName(new.select(F.col("n").alias("node"), F.col("r").alias("root"))).distinct(), "roots")


def _order(steps: Steps, rows: DataFrame, width: int, percent: int):
    """The broadcast order of tokens."""
    spark = rows.sparkSession
    text_col = rows.columns[1]
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(2 * size * counted_share(percent) / GROUP_BYTES))  # 12 bytes a word of 6
    counted = steps.write(_count(rows, width, percent, parts), "counts")
    # The count from which a token is frequent: the least power of two that keeps the table bounded.
    limit, total = FREQUENT, 0
    for r in sorted(counted.where("kind = 0").groupBy(F.floor(F.log2("value")).alias("l")).count().collect(), reverse=True):
        total += r[1]
        if total > MOST_FREQUENT:
            limit = 2 ** (int(r[0]) + 1)
            break
    often = counted.where(f"kind = 0 and value >= {limit}").select("key", (F.col("value") >= limit * VERY).alias("very")).collect()
    frequent = np.array([r[0] for r in often], np.int64).view(np.uint64)
    k = np.array([3 if r[1] else 2 for r in often], np.int8)
    by = np.argsort(frequent)
    active = np.zeros(1 << (ACTIVE_BITS - 6), np.int64)
    for r in counted.where("kind = 1").groupBy("key").agg(F.bit_or("value")).toLocalIterator():  # at most 2**20 rows
        active[r[0]] = r[1]
    steps.drop(counted)
    return spark.sparkContext.broadcast(Order(frequent[by], k[by], active, percent))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), and print (xxhash64 of the text),
    which tells rows that share an id apart."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    steps = Steps(spark, "jaccard")
    by_bytes(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("print"))
    order = _order(steps, rows, width, percent)
    both = steps.write(_index(rows, width, order), "index", "kind")
    classes = both.where("kind = 0").select("doc_id", "print", "n", "class")
    first = steps.write(classes.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first")), "first")
    sketches = both.where("kind = 0 and sketch is not null").select("class", "n", "sketch").dropDuplicates(["class"])
    # Buckets of one set only are left out.
    index = both.where("kind = 1").select("sig", "class", "n")
    centre = index.groupBy("sig").agg(F.min(F.struct("class", "n")).alias("c"), F.max("class").alias("z")).where("c.class <> z").select(F.col("sig").alias("s"), F.col("c.class").alias("a"), F.col("c.n").alias("na"))
    buckets = steps.write(index.join(centre, F.col("sig") == F.col("s")).select("sig", "class", "n", "a", "na").distinct(), "buckets")
    fit = 100 * F.least("n", "na") >= percent * F.greatest("n", "na")
    star = buckets.where((F.col("class") != F.col("a")) & fit).groupBy("a", F.col("class").alias("b")).agg(F.count("*").alias("weight"))
    star = steps.write(star, "met")
    sketches = steps.write(sketches.join(buckets.select("class").distinct(), "class", "left_semi"), "sketches")
    near = steps.write(_pruned(star, sketches, percent), "near")
    release(spark)
    # Each set with the smaller one that it shares most signatures with: a forest of at most one edge a set.
    lead = steps.write(near.groupBy("b").agg(F.max_by("a", F.struct("weight", "a")).alias("a")), "lead")
    root = steps.write(components(steps, verify(steps, rows, first, lead, width, percent)), "roots")
    rest = _roots(near.join(lead, ["a", "b"], "left_anti"), root).where("ra <> rb").select("a", "b")
    rest = steps.write(rest, "rest")
    if not rest.isEmpty():
        root = _merge(steps, root, verify(steps, rows, first, rest, width, percent))
    # Buckets that hold several components: first the most alike pairs that would connect them, then all pairs that could
    # link in the buckets where such pairs are still apart.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    checked, some = near.select("a", "b"), None
    for forest in (True, False):
        at = buckets if some is None else buckets.join(some, F.col("sig") == F.col("s"), "left_semi")
        at = at.join(root, F.col("class") == F.col("node"), "left").select("sig", "class", "n", F.coalesce("root", "class").alias("root"))
        at = steps.write(at, "members")
        # Sizes that fit are of one band or of two next to each other; a member with no other there is left out.
        band = F.floor(F.log("n") / float(np.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
        at = at.withColumn("band", band.cast("int"))
        split = at.groupBy("sig", "band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m"))
        split = split.groupBy("sig").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.sum("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("band", "m"))).alias("of")).where("x <> y and m > 2").select(F.col("sig").alias("s"), "of")
        around = sum((F.coalesce(F.try_element_at("of", F.col("band") + k), F.lit(0)) for k in (-1, 1)), F.coalesce(F.try_element_at("of", F.col("band")), F.lit(0)))
        at = steps.write(at.join(split, F.col("sig") == F.col("s")).where(around > 1).select("sig", "class", "n", "root"), "split")
        bytes_ = at.count() * (sketches.agg(F.avg(F.octet_length("sketch"))).first()[0] or 0.0) * 2
        found = steps.write(_within(at, sketches, percent, parts + int(bytes_ / GROUP_BYTES), forest), "within")
        more = steps.write(found.where("a is not null").select("a", "b").distinct().join(checked, ["a", "b"], "left_anti"), "more")
        some = found.where("sig is not null").select(F.col("sig").alias("s")).distinct()
        if not more.isEmpty():
            root = _merge(steps, root, verify(steps, rows, first, more, width, percent))
        release(spark)
        checked = checked.unionByName(more)
        if forest and found.isEmpty():
            break
    named = steps.write(first.join(root, F.col("class") == F.col("node"), "left").select("class", "first", F.coalesce("root", "class").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    named = steps.write(named.join(least, F.col("root") == F.col("r")).select(F.col("class").alias("c"), "component_id"), "named")
    alone = classes.where("class is null").select("doc_id", "print", "n", F.col("doc_id").alias("component_id"))
    found = classes.where("class is not null").join(named, F.col("class") == F.col("c")).select("doc_id", "print", "n", "component_id")
    out = steps.write(alone.unionByName(found), "out")
    steps.drop(*[df for path, df in steps.paths.values() if df is not out])
    release(spark)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "print")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), width=3, percent=90).drop("print")

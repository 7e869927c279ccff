"""Jaccard join of documents on their sets of 5-word shingles, by prefix filters under several global orders of the shingles.

Two sets of similarity 4/5 or more share a shingle in their prefixes (the first n - ceil(4 n / 5) + 1 of n) under any order that holds
for all documents. ORDERS orders are used, all with rare shingles first: by the number of sets that hold a shingle, and twice by
that number's magnitude with ties broken by different hashes. Candidates must share a prefix shingle under each of them; only then their
whole sets are compared.

1. Sets: each text's distinct shingle hashes of 64 bits; texts of equal sets are one kind, and only kinds are compared.
2. Holders: shingles are dealt by their first bits into shards of bounded size, packed some hundred thousands at a time, and return with
   their number of holders to their kind. Those with one holder can't be shared: a kind with fewer shared ones than its need is out.
   A shingle of HEAVY kinds or more in one pack is only announced to its shard, so that no shingle brings more than HEAVY entries a pack.
3. Groups: components of the kinds that share a prefix shingle under the first order. Shards tie their own kinds before anything is dealt,
   so that a shingle is one row of each shard.
4. Cells: a group's kinds are dealt into cells of some BLOCK kinds, each with the group's pivot (the kind with the fewest shingles of its
   own). In a cell, pairs that aren't tied yet and pass the prefix filter of every order are compared exactly. In
   a group of more cells, kinds that aren't tied to its pivot then meet those of all its cells; kinds tied to the pivot need not
   meet each other. Links return as forests, never as all pairs.

Shards know a shingle by its first 32 bits and their own number; shingles of a text that coincide so are one, and lower its need by
one each, so that no link is lost. Equal hashes of 64 bits count as equal shingles, equal sums of hashes as equal sets.

Cases: null and empty texts and those without words have the empty set and are linked with nothing, each its own component; fewer words
than a shingle make one shingle, the whole sequence; repeated rows, and rows of one doc_id, are rows of their own; a row without an
id ties others together and is named by its component, null if that has no id; other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .golay import forest
from .near_copies import kind_of, shingle_sets
from .text_bytes import mixed

ORDERS, HEAVY, BLOCK = 3, 16, 256
#: Shingles of a pack and of a shard.
PACK, SHARD = 1 << 20, 1 << 21
#: A shingle's number of holders from which it isn't told apart; HEAVY ones have it.
MOST = 255
#: A row's part in its cell: the pivot, asked, or only met by those asked.
PIVOT, ASKED, OTHER = range(3)
_SALTS = np.random.default_rng(11).integers(1, 1 << 63, ORDERS, np.uint64) | np.uint64(1)
PACKED = "shard int, origin int, kinds binary, needs binary, counts binary, shingles binary, holders binary"
_NAMES = [c.split()[0] for c in PACKED.split(", ")]


def need_of(n: int) -> int:
    """The least number of shingles that a set of n shares with one of similarity 4/5 or more."""
    return -(-4 * n // 5)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, sizes = [], []
        for values in shingle_sets(batch.column(1)):
            kinds.append(kind_of(values) if len(values) else None)
            sizes.append(len(values))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "kind", "n_shingles"])


def _rows(rows: list[tuple], names: list[str] = _NAMES) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin; the columns are sorted."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _by_shard(shard: np.ndarray, origin: int, kind: np.ndarray, need: np.ndarray, shingles: np.ndarray, holders: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of PACKED: entries by shard and, within it, by kind, whose number of entries is its count. Entries of a kind stand together."""
    order = np.argsort(shard, kind="stable")
    shard, kind, need, shingles = shard[order], kind[order], need[order], shingles[order]
    holders = None if holders is None else holders[order]
    edges = np.append(_runs(shard), len(shard)) if len(shard) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        at = a + _runs(kind[a:b])
        counts = np.diff(np.append(at, b)).astype(np.uint32)
        yield int(shard[a]), origin, kind[at].tobytes(), need[at].astype(np.uint32).tobytes(), counts.tobytes(), shingles[a:b].tobytes(), None if holders is None else holders[a:b].tobytes()


def _packed(log2_shards: int):
    """A map from texts to packs of their kinds' shingles, dealt by the shingles' first bits."""

    def pack(kinds: list[int], sets: list[np.ndarray]) -> list[tuple]:
        kinds, first = np.unique(np.array(kinds, np.int64), return_index=True)
        cut = [s >> np.uint64(32 - log2_shards) for s in (sets[i] for i in first)]
        own = [c[_runs(c)] for c in cut]  # sets are sorted, so are their first bits
        need = np.array([need_of(len(c)) - len(c) + len(o) for c, o in zip(cut, own)], np.int64)
        sizes = np.array([len(o) for o in own], np.int64)
        flat, kind, need = np.concatenate(own), np.repeat(kinds, sizes), np.repeat(need, sizes)
        ordered = np.sort(flat)
        at = _runs(ordered)
        heavy = ordered[at[np.diff(np.append(at, len(ordered))) >= HEAVY]]
        settled = np.isin(flat, heavy)
        shard = (flat >> np.uint64(32)).astype(np.int32)
        low = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = list(_by_shard(shard[~settled], 0, kind[~settled], need[~settled], low[~settled]))
        # Settled entries go on to their kind; their shingles are announced without a kind.
        rows += _by_shard(_kind_shard(kind[settled], log2_shards), -1, kind[settled], need[settled], flat[settled], np.full(int(settled.sum()), MOST, np.uint8))
        none = np.zeros(len(heavy), np.int64)
        rows += _by_shard((heavy >> np.uint64(32)).astype(np.int32), -2, none, none, (heavy & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, sets, held = [], [], 0
        for batch in batches:
            for values in shingle_sets(batch.column(0)):
                if not len(values):
                    continue
                kinds.append(kind_of(values))
                sets.append(values)
                held += len(values)
                if held >= PACK:
                    yield _rows(pack(kinds, sets))
                    kinds, sets, held = [], [], 0
        if kinds:
            yield _rows(pack(kinds, sets))

    return run


def _kind_shard(kind: np.ndarray, log2_shards: int) -> np.ndarray:
    return (mixed(kind.view(np.uint64)) >> np.uint64(64 - log2_shards)).astype(np.int32) if log2_shards else np.zeros(len(kind), np.int32)


def _unpacked(row: dict, width: type) -> tuple[np.ndarray, ...]:
    counts = np.frombuffer(row["counts"], np.uint32)
    kinds, needs = np.frombuffer(row["kinds"], np.int64), np.frombuffer(row["needs"], np.uint32)
    return np.repeat(kinds, counts), np.repeat(needs, counts), np.frombuffer(row["shingles"], width)


def _distinct(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """Entries with each (first column, second column) once, sorted by both, as a list of one part; copies of a text bring theirs again and again."""
    if not parts:
        return []
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    new = _runs(columns[0], columns[1])
    return [tuple(c[new] for c in columns)]


def _counted(log2_shards: int):
    """A map from a shard's packs to the entries of its shared shingles with their numbers of holders, dealt by kind."""

    def counted(shard: int, asks: list, heavy: list) -> list[tuple]:
        if not asks:
            return []
        shingle, kind, need = _distinct(asks)[0]
        at = _runs(shingle)
        sizes = np.diff(np.append(at, len(shingle)))
        settled = np.isin(shingle[at], np.concatenate(heavy)) if heavy else False
        holders = np.repeat(np.where(settled, MOST, np.minimum(sizes, MOST)), sizes).astype(np.uint8)
        shared = np.flatnonzero(holders > 1)
        shared = shared[np.argsort(kind[shared], kind="stable")]
        return list(_by_shard(_kind_shard(kind[shared], log2_shards), shard, kind[shared], need[shared], shingle[shared], holders[shared]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks: dict[int, list] = {}
        heavy: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["origin"] == -1:
                    yield _rows([tuple(row[c] for c in _NAMES)])
                elif row["origin"] == -2:
                    heavy.setdefault(row["shard"], []).append(np.frombuffer(row["shingles"], np.uint32))
                else:
                    kind, need, shingle = _unpacked(row, np.uint32)
                    mine = asks.setdefault(row["shard"], [])
                    mine.append((shingle, kind, need))
                    if sum(len(p[0]) for p in mine[1:]) > max(SHARD, len(mine[0][0])):
                        asks[row["shard"]] = _distinct(mine)
        for shard in list(asks):
            yield _rows(counted(shard, asks.pop(shard), heavy.get(shard, [])))

    return run


def orders_of(shingle: np.ndarray, holders: np.ndarray, p: int) -> list[np.ndarray]:
    """The first p of the shingles under each order."""
    out = []
    for k, salt in enumerate(_SALTS):
        rank = holders if k == 0 else np.frexp(holders.astype(float))[1]
        out.append(shingle[np.lexsort((mixed(shingle * salt), rank))[:p]])
    return out


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds with enough shared shingles: (kind, spare, prefixes) with 32 bits of each prefix shingle, ORDERS prefixes of ``spare`` shingles each.
    Rows without a kind tie kinds by the first order: (key, node) for each key of the shard, and with spare = -1 two kinds (key, node) tied within it."""
    parts: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            kind, need, shingle = _unpacked(row, np.uint64 if row["origin"] == -1 else np.uint32)
            if row["origin"] != -1:
                shingle = shingle.astype(np.uint64) | np.uint64(row["origin"]) << np.uint64(32)
            parts.append((kind, shingle, need, np.frombuffer(row["holders"], np.uint8)))
            if sum(len(p[0]) for p in parts[1:]) > max(SHARD, len(parts[0][0])):
                parts = _distinct(parts)
    names = ["kind", "spare", "prefixes", "key", "node"]
    if not parts:
        return
    kind, shingle, need, holders = _distinct(parts)[0]
    at = _runs(kind)
    sizes = np.diff(np.append(at, len(kind)))
    stays = np.flatnonzero(sizes >= need[at])
    kinds, spares, prefixes, firsts = [], [], [], []
    for i in stays:
        a, n = at[i], sizes[i]
        p = int(n - need[a] + 1)
        found = orders_of(shingle[a : a + n], holders[a : a + n], p)
        kinds.append(int(kind[a]))
        spares.append(p)
        prefixes.append(mixed(np.concatenate(found)).astype(np.uint32).tobytes())
        firsts.append(found[0])
    if not kinds:
        return
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(spares, pa.int32()), pa.array(prefixes, pa.binary()), pa.nulls(len(kinds), pa.int64()), pa.nulls(len(kinds), pa.int64())], names)
    keys, to = np.unique(np.concatenate(firsts), return_inverse=True)
    links = np.stack([np.repeat(np.arange(len(kinds)), [len(f) for f in firsts]), len(kinds) + to], axis=1)
    root = np.arange(len(kinds) + len(keys))
    tied = forest(links)
    root[tied[:, 0]] = tied[:, 1]  # the least of a component, which is a kind
    named = np.array(kinds, np.int64)
    inner = np.flatnonzero(root[: len(kinds)] != np.arange(len(kinds)))
    key = np.concatenate([mixed(keys).view(np.int64), named[inner]])
    node = np.concatenate([named[root[len(kinds) :]], named[root[inner]]])
    none = np.ones(len(key), bool)
    kind_column = pa.array(np.zeros(len(key), np.int64), pa.int64(), mask=none)
    # spare is null for a key's row and -1 for a tie of two kinds.
    spare = pa.array(np.full(len(key), -1, np.int32), pa.int32(), mask=np.arange(len(key)) < len(keys))
    yield pa.RecordBatch.from_arrays([kind_column, spare, pa.nulls(len(key), pa.binary()), pa.array(key), pa.array(node)], names)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each node of a key with the key's first; rows are sorted by key and node."""
    key_before, first_before = None, None
    for batch in batches:
        key, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        if not len(key):
            continue
        at = _runs(key)
        first = np.repeat(node[at], np.diff(np.append(at, len(key))))
        if key_before == key[0]:
            first[: at[1] if len(at) > 1 else len(key)] = first_before
        key_before, first_before = key[-1], first[-1]
        apart = node != first
        tied = forest(np.stack([node[apart], first[apart]], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(tied[:, 0], pa.int64()), pa.array(tied[:, 1], pa.int64())], ["a", "b"])


def cell_links(sets: list[np.ndarray], prefixes: list[np.ndarray], root: np.ndarray, asked: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j), one of them asked, whose components, with those that ``root`` names, are those of all such pairs of similarity 4/5 or more."""
    sizes, root, found = np.array([len(s) for s in sets], np.int64), root.copy(), []

    def numbered(parts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        n = [len(p) for p in parts]
        kinds, at = np.unique(np.concatenate(parts), return_inverse=True)
        return np.split(at, np.cumsum(n)[:-1]), at, np.repeat(np.arange(len(parts)), n), np.zeros(len(kinds), bool)

    orders = [numbered(parts) for parts in zip(*(p.reshape(ORDERS, -1) for p in prefixes))]
    whole = numbered(sets)[0::3]
    for i in np.flatnonzero(asked):
        other = np.flatnonzero((root != root[i]) & (5 * np.minimum(sizes, sizes[i]) >= 4 * np.maximum(sizes, sizes[i])))
        other = other[~asked[other] | (other > i)]
        for parts, at, owner, held in orders:
            if not len(other):
                break
            held[parts[i]] = True
            hit = np.zeros(len(sets), bool)
            hit[owner[held[at]]] = True
            held[parts[i]] = False
            other = other[hit[other]]
        if not len(other):
            continue
        parts, held = whole
        held[parts[i]] = True
        shared = np.array([np.count_nonzero(held[parts[j]]) for j in other], np.int64)
        held[parts[i]] = False
        linked = other[5 * shared >= 4 * (sizes[i] + sizes[other] - shared)]
        if len(linked):
            found.extend((int(i), int(j)) for j in linked)
            root[np.isin(root, root[linked])] = root[i]
    return found


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest of the links in each cell; rows (cell, asked, kind, root, prefixes, shingles) are sorted by cell and part."""
    cell, rows, out = None, [], []

    def links() -> list[tuple[int, int]]:
        kinds = list(dict.fromkeys(r["kind"] for r in rows))
        if len(kinds) < 2:
            return []
        held = {r["kind"]: r for r in reversed(rows)}  # a kind's first row
        own = [held[k] for k in kinds]
        found = cell_links([np.frombuffer(r["shingles"], np.uint64) for r in own], [np.frombuffer(r["prefixes"], np.uint32) for r in own], np.array([r["root"] for r in own]), np.array([r["asked"] < OTHER for r in own]))
        return [(kinds[i], kinds[j]) for i, j in found]

    def made() -> pa.RecordBatch:
        tied = forest(np.array(out, np.int64).reshape(-1, 2))
        return pa.RecordBatch.from_arrays([pa.array(tied[:, 0], pa.int64()), pa.array(tied[:, 1], pa.int64())], ["a", "b"])

    for batch in batches:
        for n in range(batch.num_rows):  # a row at a time, so that a cell's sets are in memory once
            row = batch.slice(n, 1).to_pylist()[0]
            if row["cell"] != cell:
                out.extend(links())
                cell, rows = row["cell"], []
            rows.append(row)
        if len(out) > 1 << 16:
            yield made()
            out = []
    out.extend(links())
    yield made()


def _by(rows: DataFrame, key: str, *then: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, *then)


def prefix_groups(texts: DataFrame, shingles: int) -> tuple[DataFrame, DataFrame]:
    """(kind, spare, prefixes) of the kinds that pass the first filter, and (kind, group) of those that share a key with another."""
    log2_shards = min(30, max(0, (shingles // SHARD).bit_length()))
    shards = 1 << log2_shards
    packs = texts.select("text").mapInArrow(_packed(log2_shards), PACKED).repartitionById(shards, F.col("shard"))
    back = packs.mapInArrow(_counted(log2_shards), PACKED).repartitionById(shards, F.col("shard"))
    made = common.materialize(back.mapInArrow(_filtered, "kind long, spare int, prefixes binary, key long, node long"), "prefixes")
    stars = _by(made.where("kind IS NULL AND spare IS NULL").select("key", "node"), "key", "node").mapInArrow(_stars, "a long, b long")
    ties = made.where("kind IS NULL AND spare = -1").select(F.col("key").alias("a"), F.col("node").alias("b"))
    tied = components(common.materialize(stars.unionByName(ties), "prefix-ties"))
    groups = common.materialize(tied.select(F.col("node").alias("kind"), F.col("component").alias("group")), "prefix-groups")
    return made.where("kind IS NOT NULL").select("kind", "spare", "prefixes"), groups


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            sets = [s for s in shingle_sets(batch.column(0).slice(at, 64)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(map(kind_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["kind", "shingles"])


def verified_links(texts: DataFrame, holders: DataFrame, shingles: int) -> DataFrame:
    """(a, b): links whose components are those of all pairs of kinds of similarity 4/5 or more. ``holders`` has (kind, holder), a doc_id of each kind."""
    kept, groups = prefix_groups(texts, shingles)
    # The sets of one text of each kind that is in a group; texts of other kinds are never moved.
    kind_bits = common.written_bitmap(groups, "kind")
    asked = common.with_suspicion(holders, "kind", kind_bits, "suspect").where("suspect").select("holder")
    held = common.with_suspicion(texts, "holder", common.written_bitmap(asked, "holder"), "suspect").where("suspect").select("text")
    sets = common.with_suspicion(held.mapInArrow(_sets, "kind long, shingles binary"), "kind", kind_bits, "suspect").where("suspect").drop("suspect")
    kept = common.with_suspicion(kept, "kind", kind_bits, "suspect").where("suspect").drop("suspect")
    members = kept.join(groups.withColumnRenamed("kind", "member"), F.col("kind") == F.col("member")).drop("member")
    members = members.join(sets.dropDuplicates(["kind"]).withColumnRenamed("kind", "of"), F.col("kind") == F.col("of")).drop("of")
    members = common.materialize(members, "group-members")
    # How many cells a group has, and its pivot: the most of its shingles are shared, given how many must be.
    rank = F.struct((-F.col("spare") / F.length("shingles")).alias("r"), F.col("kind").alias("k"))
    sizes = common.materialize(
        members.groupBy(F.col("group").alias("g")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cells"), F.min(rank)["k"].alias("pivot")), "group-sizes"
    )
    wide = common.materialize(sizes.where("cells > 1"), "wide-groups")
    cell_of = F.xxhash64("group", F.when(F.col("cells") > 1, F.pmod(F.xxhash64("kind", F.lit(5)), F.col("cells"))))
    columns = ["cell", "asked", "kind", "root", "prefixes", "shingles"]
    wide_bits = common.written_bitmap(wide, "g")
    marked = common.with_suspicion(members, "group", wide_bits, "suspect")
    small = marked.where("NOT suspect").withColumn("cells", F.lit(1))
    large = marked.where("suspect").drop("suspect").join(wide, F.col("group") == F.col("g"), "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    own = small.withColumn("asked", F.lit(ASKED)).select(cell_of.alias("cell"), "asked", "kind", F.col("kind").alias("root"), "prefixes", "shingles")
    large = common.materialize(large.drop("g"), "wide-members")
    pivots = large.where("kind = pivot").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    own = own.unionByName(large.withColumn("asked", F.lit(ASKED)).select(cell_of.alias("cell"), "asked", "kind", F.col("kind").alias("root"), "prefixes", "shingles"))
    own = own.unionByName(pivots.select(F.xxhash64("group", F.col("n").cast("long")).alias("cell"), F.lit(PIVOT).alias("asked"), "kind", F.col("kind").alias("root"), "prefixes", "shingles"))
    links = common.materialize(_by(own.select(*columns), "cell", "asked", "kind").mapInArrow(_compared, "a long, b long"), "cell-links")
    # In groups of several cells: kinds that aren't tied to the pivot meet all others.
    roots = common.materialize(components(links).select(F.col("node").alias("n"), F.col("component").alias("c")), "cell-roots")
    rooted = large.where("cells > 1").join(roots, F.col("kind") == F.col("n"), "left").withColumn("root", F.coalesce("c", "kind")).drop("n", "c")
    pivot_roots = common.materialize(rooted.where("kind = pivot").select(F.col("group").alias("g"), F.col("root").alias("pivot_root")), "pivot-roots")
    rooted = common.materialize(rooted.join(pivot_roots, F.col("group") == F.col("g")).drop("g"), "rooted-members")
    apart = rooted.where("root <> pivot_root")
    rows_of = common.materialize(apart.groupBy(F.col("group").alias("g")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rows")), "rows-apart")
    dealt = rooted.join(rows_of, F.col("group") == F.col("g"))
    row = F.pmod(F.xxhash64("kind", F.lit(7)), F.col("rows"))
    column = F.pmod(F.xxhash64("kind", F.lit(5)), F.col("cells"))
    asks = dealt.where("root <> pivot_root").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(F.xxhash64("group", row, F.col("c").cast("long")).alias("cell"), F.lit(ASKED).alias("asked"), "kind", "root", "prefixes", "shingles")
    others = dealt.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select(F.xxhash64("group", F.col("r").cast("long"), column).alias("cell"), F.lit(OTHER).alias("asked"), "kind", "root", "prefixes", "shingles")
    crossed = common.materialize(_by(asks.unionByName(others), "cell", "asked", "kind").mapInArrow(_compared, "a long, b long"), "crossed-links")
    return links.unionByName(crossed)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links)."""
    last = F.lit((1 << 63) - 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = common.materialize(texts.mapInArrow(_kinds, "doc_id long, kind long, n_shingles long"), "document-kinds")
    n, shingles = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    kinds = common.materialize(rows.where("kind IS NOT NULL").groupBy("kind").agg(F.min(F.coalesce("doc_id", last)).alias("holder")), "join-kinds", n)
    tied = components(verified_links(texts.withColumn("holder", F.coalesce("doc_id", last)), kinds, int(shingles)))
    labelled = common.materialize(kinds.join(tied, F.col("kind") == F.col("node"), "left").select("kind", "holder", F.coalesce("component", "kind").alias("root")), "join-labels", n)
    named = common.materialize(labelled.groupBy(F.col("root").alias("named")).agg(F.min("holder").alias("component_id")), "join-names", n)
    of_kind = common.materialize(labelled.join(named, F.col("root") == F.col("named")).select(F.col("kind").alias("key_kind"), F.nullif("component_id", last).alias("component_id")), "join-components", n)
    lone = rows.where("kind IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("kind IS NOT NULL").join(of_kind, F.col("kind") == F.col("key_kind")).select("doc_id", "n_shingles", "component_id").unionByName(lone)

"""Exact set-similarity self-join on word shingles, with set-relation skipping.

The plan, for sets that may number billions:

1. Every text becomes its set of distinct shingles (64-bit hashes).  Equal sets
   form one class; only one row of a class goes on, so exact copies cost
   nothing further.
2. Tokens are dealt by hash range in packed arrays.  A range learns how many
   sets hold each token and sends back only tokens in two sets or more.  A token
   that one block of sets holds several times goes to its range once, with its
   count, so a token that all sets hold costs its range one entry per block.  A
   set with fewer than ceil(t * n) shared tokens can link to nothing and ends here.
3. The rest are ordered by rising frequency.  Sets with the same smallest hash
   are grouped, and a few of them (leaders) answer for those highly similar to
   them: their clusters are stars of checked links.
4. Index lists of the prefix tokens hold (cluster, set sizes, position), each
   cluster once.  They are cut into blocks by size; whole blocks are skipped
   when their sizes or what is left after their positions cannot reach the
   threshold.  What remains are pairs of clusters.  A long list is dealt over
   several tasks, each of which meets two parts of it.
5. A pair of clusters is checked whole.  The overlaps of one leader with all
   members of the other cluster are counted through an inverted index; those of
   the sets behind the leader are derived from its overlaps by the few tokens in
   which they differ.  Links are counted for every set, those inside a cluster
   likewise.
6. Links between clusters are closed into components.

No pair of documents is ever written, and no group is held whole by one task:
groups of one smallest hash, index lists and the pairs of one cluster are dealt
over several tasks by their counted size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut, drop_cut, only, partitions, salted_join, shared_folder, small_side
from .components import connected_components

SHINGLE_WORDS = 5
THRESHOLD = (75, 100)
#: Tokens of one hash range, and of one block of sets.
RANGE_TOKENS = 1_000_000
BLOCK_TOKENS = 400_000
#: Sets and tokens that are clustered at once, and that one cluster is checked against at once.
CLUSTER_SETS, CLUSTER_TOKENS = 250, 400_000
PAIR_SETS, PAIR_TOKENS = 250, 400_000
#: Entries of a part of an index list, and of the blocks in which parts are compared.
LIST_PART, LIST_BLOCK = 2_000, 256
#: Tokens that a task of the later steps gets, about.
TASK_TOKENS = 2_000_000


def shingle_sets(column):
    """(row, sorted distinct 64-bit shingle hashes) for each text of an Arrow column."""
    for first, end, data, offsets in tk.text_slices(column):
        hashes, _, _, word_of = tk.words(data, offsets, tk.NOT_SPACE, tk.LOWER_ASCII)
        runs = tk.grams(hashes, SHINGLE_WORDS)
        for i in range(end - first):
            a, b = word_of[i], word_of[i + 1]
            if b - a >= SHINGLE_WORDS:
                yield first + i, np.unique(runs[a : b - SHINGLE_WORDS + 1])
            elif b > a:
                yield first + i, tk.grams(hashes[a:b], int(b - a))
            else:
                yield first + i, np.zeros(0, np.uint64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set; the first is its node in the graph of links."""
    one = int(tk.mix(s).sum(dtype=np.uint64))
    two = np.bitwise_xor.reduce(tk.mix(s * np.uint64(0xD6E8FEB86659FD93)))
    return int(tk.mix(np.array([one ^ len(s)], np.uint64) + two)[0].view(np.int64)), int(two.view(np.int64))


def _signatures(batches):
    for batch in batches:
        n, node, second = (np.zeros(len(batch), np.int64) for _ in range(3))
        for row, s in shingle_sets(batch.column("text")):
            n[row] = len(s)
            if len(s):
                node[row], second[row] = _signature(s)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n), pa.array(node), pa.array(second)], names=["doc_id", "text_hash", "n_shingles", "node", "second"])


def _packed_tokens(ranges: int):
    """Rows (rng, block, tokens, many).

    tokens: those of a block of sets in one hash range, 48 bits of hash and 16 of
    row.  many: tokens that the block holds several times, and how often.  And
    one row for the block itself (rng below 0): nodes and sizes of its sets, and
    in `many` which sets hold the tokens that occur several times."""

    def run(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            nodes = np.zeros(len(whole), np.int64)
            sizes, sets, held, start = np.zeros(len(whole), np.int32), [], 0, 0
            for row, s in shingle_sets(whole.column("text")):
                sizes[row] = len(s)
                if len(s):
                    nodes[row] = _signature(s)[0]
                sets.append(s)
                held += len(s)
                # a block ends at so many tokens, so that memory doesn't follow the batch
                if held >= BLOCK_TOKENS or row - start + 1 >= 0xFFFF or row + 1 == len(whole):
                    if held:
                        yield pack((task << 32) | k, nodes[start : row + 1], sizes[start : row + 1], sets)
                        k += 1
                    sets, held, start = [], 0, row + 1

    def pack(block, nodes, sizes, sets):
        token = np.concatenate(sets)
        row = np.repeat(np.arange(len(nodes), dtype=np.uint16), sizes)
        order = np.argsort(token)  # by token, and thereby by range
        token, row = token[order], row[order]
        same = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        times = np.diff(same)
        rng = _range_of(token, ranges)
        once = np.repeat(times == 1, times)
        single = (token[once] << np.uint64(16)) | row[once]
        often = same[:-1][times > 1]
        many = np.zeros(len(often), MANY)
        many["token"], many["times"] = token[often] & np.uint64((1 << 48) - 1), times[times > 1]
        inside = np.zeros(int((~once).sum()), INSIDE)
        inside["token"], inside["row"] = _name(token[~once], rng[~once]), row[~once]
        at, at_many = (np.concatenate([[0], np.cumsum(np.bincount(r, minlength=ranges))]) for r in (rng[once], rng[often]))
        used = np.flatnonzero(np.diff(at) + np.diff(at_many))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([used, [-1 - block % ranges]]).astype(np.int64)),
                pa.array(np.full(len(used) + 1, block, np.int64)),
                pa.array([*(single[at[r] : at[r + 1]].tobytes() for r in used), nodes.tobytes() + sizes.tobytes()], pa.binary()),
                pa.array([*(many[at_many[r] : at_many[r + 1]].tobytes() for r in used), inside.tobytes()], pa.binary()),
            ],
            names=["rng", "block", "tokens", "many"],
        )

    return run


def _range_of(token: np.ndarray, ranges: int) -> np.ndarray:
    """The range is taken from the 16 bits that the packed form leaves out, and more."""
    return ((token >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _name(token: np.ndarray, rng) -> np.ndarray:
    """A token's name behind the ranges: the lower 48 bits of its hash, and 16 bits of the range, which says the rest."""
    return (token << np.uint64(16)) | np.asarray(rng % 65536).astype(np.uint64)


MANY = np.dtype([("token", "<u8"), ("times", "<i4")])
INSIDE = np.dtype([("token", "<u8"), ("row", "<u2")])
TOKEN = np.dtype([("token", "<u8"), ("count", "<i8"), ("row", "<u2")])
#: The row of an entry that stands for several sets of its block.
SEVERAL = 0xFFFF


def _shared_tokens(data: pa.Table) -> pa.Table:
    """Of one range: for each block its tokens that two sets hold, with the count; the rows of blocks pass."""
    rng = data.column("rng")[0].as_py()
    if rng < 0:
        return data.select(["block", "tokens", "many"]).append_column("meta", pa.array(np.ones(len(data), bool)))
    blobs, more = data.column("tokens").to_pylist(), data.column("many").to_pylist()
    packed, many = np.frombuffer(b"".join(blobs), np.uint64), np.frombuffer(b"".join(more), MANY)
    token = np.concatenate([packed >> np.uint64(16), many["token"]])
    row = np.concatenate([packed & np.uint64(0xFFFF), np.full(len(many), SEVERAL, np.uint64)])
    block = np.concatenate([np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs]), np.repeat(np.arange(len(more)), [len(m) // MANY.itemsize for m in more])])
    times = np.concatenate([np.ones(len(packed), np.int64), many["times"].astype(np.int64)])
    order = np.argsort(token, kind="stable")
    s = token[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    total = np.add.reduceat(times[order], first) if len(s) else times
    count = np.empty(len(s), np.int64)
    count[order] = np.repeat(total, np.diff(np.append(first, len(s))))
    keep = np.flatnonzero(count > 1)
    keep = keep[np.argsort(block[keep], kind="stable")]
    out = np.zeros(len(keep), TOKEN)
    out["token"], out["count"], out["row"] = _name(token[keep], rng), count[keep], row[keep]
    some, starts = np.unique(block[keep], return_index=True)
    parts = [x.tobytes() for x in np.split(out, starts[1:])] if len(some) else []
    return pa.table({"block": data.column("block").take(pa.array(some, pa.int64())), "tokens": pa.array(parts, pa.binary()), "many": pa.nulls(len(some), pa.binary()), "meta": pa.array(np.zeros(len(some), bool))})


def _survivors(num: int, den: int):
    def run(data: pa.Table) -> pa.Table:
        """Of one block: each set that may link, its shared tokens by rising count."""
        meta = np.asarray(data.column("meta"))
        blobs, more = data.column("tokens").to_pylist(), data.column("many").to_pylist()
        own = int(np.flatnonzero(meta)[0])
        about, n_rows = blobs[own], len(blobs[own]) // 12
        nodes, sizes = np.frombuffer(about, np.int64, n_rows), np.frombuffer(about, np.int32, n_rows, n_rows * 8)
        found = np.frombuffer(b"".join(b for b, m in zip(blobs, meta) if not m), TOKEN)
        inside = np.frombuffer(more[own], INSIDE)
        several = found["row"] == SEVERAL
        counted = found[several]
        counted = counted[np.argsort(counted["token"])]
        again = np.zeros(len(inside), TOKEN)
        again["token"], again["row"] = inside["token"], inside["row"]
        again["count"] = counted["count"][np.searchsorted(counted["token"], inside["token"])] if len(inside) else 0
        found = np.concatenate([found[~several], again])
        m = np.bincount(found["row"], minlength=n_rows)
        keep = np.flatnonzero((m > 0) & (m * den >= num * sizes))
        found = found[np.isin(found["row"], keep)]
        found = found[np.lexsort((found["token"], found["count"], found["row"]))]
        ends = np.cumsum(m[keep])
        return pa.table({"node": pa.array(nodes[keep]), "n": pa.array(sizes[keep]), "tokens": pa.array([x["token"].tobytes() for x in np.split(found, ends[:-1])] if len(keep) else [], pa.binary())})

    return run


def _index(sets: list[np.ndarray]):
    """Sorted tokens of all sets, and the set of each."""
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    return every[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]


def _overlaps(index, tokens: np.ndarray, n: int) -> np.ndarray:
    token, owner = index
    a = np.searchsorted(token, tokens, "left")
    return np.bincount(owner[tk.spread(a, np.searchsorted(token, tokens, "right") - a)], minlength=n)


def _groups(batches, keys: list[str]):
    """The groups of a partition that is sorted by keys, one after the other."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        changed = np.zeros(len(batch), bool)
        for k in keys:
            x = np.asarray(batch.column(k))
            changed[1:] |= x[1:] != x[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), len(batch)]
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _derived(index, own: int, sets: list[np.ndarray]) -> np.ndarray:
    """Overlaps of each of `sets` with the `own` sets of the index; those of all but the first are derived from the first's."""
    first = np.sort(sets[0])
    base = _overlaps(index, first, own)
    if len(sets) == 1:
        return base[None, :]
    token = np.concatenate(sets[1:])
    row = np.repeat(np.arange(len(sets) - 1), [len(s) for s in sets[1:]])
    at = np.minimum(np.searchsorted(first, token), len(first) - 1)
    both = first[at] == token
    gone = np.ones((len(sets) - 1, len(first)), bool)
    gone[row[both], at[both]] = False
    out = np.empty((len(sets), own), np.int64)
    out[0] = base
    out[1:] = base
    for rows, tokens, sign in ((row[~both], token[~both], 1), (*_gone_tokens(gone, first), -1)):
        if len(tokens):
            a = np.searchsorted(index[0], tokens, "left")
            k = np.searchsorted(index[0], tokens, "right") - a
            cell = np.repeat(rows * own, k) + index[1][tk.spread(a, k)]
            out[1:] += sign * np.bincount(cell, minlength=own * (len(sets) - 1)).reshape(-1, own)
    return out


def _gone_tokens(gone: np.ndarray, first: np.ndarray):
    row, at = np.nonzero(gone)
    return row, first[at]


def _clusters(num: int, den: int):
    def run(batches):
        """Groups of one smallest hash: stars of checked links.  Columns: node, n, copies, tokens, leader, members, links inside the cluster."""
        for data in _groups(batches, ["key", "salt"]):
            node, n, copies = (np.asarray(data.column(c)) for c in ("node", "n", "copies"))
            n = n.astype(np.int64)
            leader, links = node.copy(), np.zeros(len(node), np.int64)
            if len(data) > 1:
                sets = [np.frombuffer(b, np.uint64) for b in data.column("tokens").to_pylist()]
                index, free = _index(sets), np.ones(len(sets), bool)
                for i in np.lexsort((node, n)):
                    if free[i]:
                        both = _overlaps(index, sets[i], len(sets))
                        linked = free & (den * both >= num * (n + n[i] - both))
                        linked[i] = True
                        leader[linked] = node[i]
                        free &= ~linked
                        if linked.sum() > 1:
                            own = np.concatenate([[i], np.setdiff1d(np.flatnonzero(linked), [i])])
                            both = _derived(_index([sets[j] for j in own]), len(own), [sets[j] for j in own])
                            yes = den * both >= num * (n[own][:, None] + n[own][None, :] - both)
                            np.fill_diagonal(yes, False)
                            links[own] = yes @ copies[own]
            _, which, members = np.unique(leader, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), data.column("n").combine_chunks(), pa.array(copies), data.column("tokens").combine_chunks(), pa.array(leader), pa.array(members[which].astype(np.int32)), pa.array(links)],
                names=["node", "n", "copies", "tokens", "leader", "members", "links"],
            )

    return run


def _postings(num: int, den: int):
    def run(batches):
        """(token, leader, members, n, rest) for the prefix tokens; rest: tokens from here on, itself included."""
        for batch in batches:
            n = np.asarray(batch.column("n")).astype(np.int64)
            sets = [np.frombuffer(b, np.uint64) for b in batch.column("tokens").to_pylist()]
            m = np.array([len(s) for s in sets], np.int64)
            take = np.minimum(m, n - (num * n + den - 1) // den + 1 - (n - m))
            token = np.concatenate([s[:k] for s, k in zip(sets, take)]) if len(sets) else np.zeros(0, np.uint64)
            rest = np.repeat(m, take) - tk.spread(np.zeros(len(take), np.int64), take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(np.repeat(np.asarray(batch.column("leader")), take)), pa.array(np.repeat(np.asarray(batch.column("members")), take)), pa.array(np.repeat(n, take).astype(np.int32)), pa.array(rest.astype(np.int32))],
                names=["token", "leader", "members", "n", "rest"],
            )

    return run


def _list_pairs(x, y, num: int, den: int):
    """Cluster pairs of two parts of one index list, or of one part with itself (y is x).

    A part: arrays low, high, rest, leader.  An entry stands for a cluster: the
    sizes of its sets with this token are within low and high, and at most
    `rest` tokens are left from the token's place on.  Blocks of LIST_BLOCK
    entries by rising size; blocks that cannot reach the threshold by their
    sizes or places are skipped."""
    x, y = ([c[np.argsort(part[0], kind="stable")] for c in part] for part in (x, y)) if y is not x else [[c[np.argsort(x[0], kind="stable")] for c in x]] * 2
    blocks = [[(a, part[0][a], part[1][a : a + LIST_BLOCK].max(), part[2][a : a + LIST_BLOCK].max()) for a in range(0, len(part[0]), LIST_BLOCK)] for part in (x, y)]
    # the largest size up to each block, since sizes rise by their lower ends only
    reach = np.maximum.accumulate([high for _, _, high, _ in blocks[1]])
    out = []
    for a, low_a, high_a, rest_a in blocks[0]:
        for k, (b, low_b, high_b, rest_b) in enumerate(blocks[1]):
            if y is x and b < a or den * reach[k] < num * low_a or den * high_b < num * low_a:
                continue
            if den * high_a < num * low_b:
                break  # this block and all later ones hold sets that are too large
            if (num + den) * min(rest_a, rest_b) < num * (low_a + low_b):
                continue
            (low_i, high_i, rest_i, i), (low_j, high_j, rest_j, j) = ([c[s : s + LIST_BLOCK] for c in part] for part, s in ((x, a), (y, b)))
            fits = (den * high_i[:, None] >= num * low_j[None]) & (den * high_j[None] >= num * low_i[:, None])
            fits &= (num + den) * np.minimum(rest_i[:, None], rest_j[None]) >= num * (low_i[:, None] + low_j[None])
            u, v = np.nonzero(fits & (i[:, None] < j[None] if y is x and a == b else i[:, None] != j[None]))
            out.append(np.stack([i[u], j[v]], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _candidates(num: int, den: int):
    def run(batches):
        """Pairs (a, b) of clusters, a the one of more sets, from groups of one (token, cell); part tells the two parts of a cell apart."""
        found, held, size = [], 0, {}

        def flush():
            pairs = np.unique(np.concatenate(found), axis=0)
            swap = [(size[a], a) < (size[b], b) for a, b in pairs.tolist()]
            pairs[swap] = pairs[swap][:, ::-1]
            pairs = np.unique(pairs, axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for data in _groups(batches, ["token", "cell"]):
            if len(data) < 2:
                continue
            columns = [np.asarray(data.column(c)).astype(np.int64) for c in ("low", "high", "rest", "leader")]
            part = np.asarray(data.column("part"))
            one = part == part[0]
            parts = [[c[one] for c in columns], [c[~one] for c in columns]]
            cell = data.column("cell")[0].as_py()
            if cell >> 32 != cell & 0xFFFFFFFF:
                pairs = _list_pairs(*parts, num, den) if len(parts[1][0]) else []
            else:
                pairs = _list_pairs(parts[0], parts[0], num, den)
            if len(pairs):
                size.update(zip(columns[3].tolist(), np.asarray(data.column("members")).tolist()))
                found.append(pairs)
                held += len(pairs)
                if held > 200_000:
                    yield flush()
                    found, held, size = [], 0, {}
        if found:
            yield flush()

    return run


def _links(num: int, den: int):
    def run(batches):
        """Rows (u, v, -, -): clusters with a link between them; rows (-, -, node, links): links of a set that a task has found.

        A group: the members of a (b is null), then those of each b, its leader first."""
        for data in _groups(batches, ["a", "salt"]):
            b = np.asarray(data.column("b").combine_chunks().fill_null(-(2**63)))
            head = np.asarray(data.column("head"))
            own = np.flatnonzero(head < 0)
            order = np.lexsort((head, b))
            order = order[head[order] >= 0]
            if not len(own) or not len(order):
                continue
            node, n, copies = (np.asarray(data.column(c)).astype(np.int64) for c in ("node", "n", "copies"))
            sets = [np.frombuffer(x, np.uint64) for x in data.column("tokens").to_pylist()]
            index, links, linked = _index([sets[i] for i in own]), np.zeros(len(node), np.int64), []
            starts = np.concatenate([[0], np.flatnonzero(np.diff(b[order])) + 1, [len(order)]])
            for s, e in zip(starts[:-1], starts[1:]):
                other = order[s:e]
                both = _derived(index, len(own), [sets[i] for i in other])
                yes = den * both >= num * (n[own][None, :] + n[other][:, None] - both)
                if yes.any():
                    linked.append(b[other[0]])
                    links[own] += copies[other] @ yes
                    links[other] += yes @ copies[own]
            if linked:
                some = np.flatnonzero(links)
                u = pa.array(np.full(len(linked), data.column("a")[0].as_py(), np.int64))
                none = lambda k: pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([u, pa.array(np.array(linked, np.int64)), none(len(linked)), none(len(linked))], names=["u", "v", "node", "links"])
                yield pa.RecordBatch.from_arrays([none(len(some)), none(len(some)), pa.array(node[some]), pa.array(links[some])], names=["u", "v", "node", "links"])

    return run


_KEY = ["n_shingles", "node", "second"]


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_hash, n_shingles, node, second; classes of equal sets: their key, rep, weight, class_size)."""
    sets = cut(docs.mapInArrow(_signatures, "doc_id long, text_hash long, n_shingles long, node long, second long"), "sets")
    known = F.col("doc_id").isNotNull()
    classes = sets.where("n_shingles > 0").groupBy(*_KEY).agg(
        F.min(F.when(known, F.struct("doc_id", "text_hash"))).alias("rep"), F.sum(known.cast("long")).alias("weight"), F.count(F.lit(1)).alias("class_size")
    )
    return sets, cut(classes, "classes")


def _once(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows without repeats of one doc_id and text."""
    twice = sets.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    twice = small_side(cut(twice, "twice"))
    on = ["doc_id", "text_hash"]
    return rows.join(twice, on, "left_anti").select(rows.columns).unionByName(rows.join(twice, on, "left_semi").select(rows.columns).dropDuplicates(on))


def _linked(docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, text_hash, n_shingles, group (a node of its component), component_id, class_size, n_links."""
    num, den = threshold
    spark = docs.sparkSession
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    sets, classes = _classes(docs)
    # of each class the row of its representative; a row is told by doc_id and text
    others = salted_join(sets, classes.where("class_size > 1").select(*_KEY, "rep"), _KEY).where("doc_id is not null and struct(doc_id, text_hash) <> rep").select("doc_id", "text_hash").distinct()
    first = docs.where("doc_id is not null").join(small_side(cut(others, "others")), ["doc_id", "text_hash"], "left_anti").select("doc_id", "text_hash", "text")
    first = _once(first, sets)
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    found = classes.withColumns({"group": F.col("node"), "links": F.lit(0).cast("long"), "component_id": F.col("rep.doc_id")})
    if total:
        ranges = partitions(spark, total, RANGE_TOKENS)
        packed = first.select("text").mapInArrow(_packed_tokens(ranges), "rng long, block long, tokens binary, many binary")
        shared = packed.repartition(ranges, "rng").groupBy("rng").applyInArrow(_shared_tokens, "block long, tokens binary, many binary, meta boolean")
        alive = shared.repartition(ranges, "block").groupBy("block").applyInArrow(_survivors(num, den), "node long, n int, tokens binary")
        heavy = small_side(classes.where("weight > 1").select("node", F.col("weight").alias("copies")))
        alive = cut(alive.join(heavy, "node", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long"))), "alive")
        label = cut(_components_of(alive, num, den), "label")
        found = classes.join(label, "node", "left").withColumns({"group": F.coalesce("group", "node"), "links": F.coalesce("links", F.lit(0).cast("long"))})
        found = cut(found, "grouped")
        # a component may hold a third of all classes, and a class a third of all rows
        found = salted_join(found, cut(found.groupBy("group").agg(F.min("rep.doc_id").alias("component_id")), "least"), "group")
    found = cut(found.select(*_KEY, "group", "component_id", "class_size", "weight", "links"), "labelled")
    row = ["doc_id", "text_hash", "n_shingles"]
    n_links = F.col("weight") + F.col("links") - F.col("doc_id").isNotNull().cast("long")
    some = salted_join(sets.where("n_shingles > 0"), found, _KEY).select(*row, "group", F.coalesce("component_id", "doc_id").alias("component_id"), "class_size", n_links.alias("n_links"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return some.unionByName(sets.where("n_shingles = 0").select(*row, F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"), one.alias("class_size"), none.alias("n_links")))


def similarity_components(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class_size, n_links.

    docs needs doc_id and text; other columns are ignored, whatever their names.
    component_id is the smallest doc_id reachable over links, where two rows
    link when den * |A and B| >= num * |A or B|.  A null or wordless text has
    no shingle and is its own component.  Equal texts (and texts with equal
    sets) link always.  Rows with one doc_id and different texts are different
    rows, linked by their texts alone.  A row whose doc_id is null gets the
    component of the rows with an equal set, or null if there is none; its text
    adds no links.  class_size is the number of rows with the same set.  n_links
    is the number of other rows with a doc_id that the row links to (for a null
    doc_id: to rows with an equal set and to those that these link to).  An
    empty table gives an empty result.
    """
    shared_folder(docs.sparkSession)
    return _linked(only(docs, doc_id="long", text="string"), threshold).select("doc_id", "n_shingles", "component_id", "class_size", "n_links")


def _components_of(alive: DataFrame, num: int, den: int) -> DataFrame:
    """(node, n, copies, tokens) -> (node, group, links): a node of the component, and links to other sets."""
    spark = alive.sparkSession
    length = F.octet_length("tokens") / 8
    keyed = alive.withColumn("key", F.pandas_udf(_smallest_hash, "long")("tokens"))
    counted = keyed.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CLUSTER_SETS), F.ceil(F.sum(length) / CLUSTER_TOKENS)).alias("salts"))
    salted = keyed.join(small_side(cut(counted.where("salts > 1"), "salts")), "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")), F.lit(0).cast("long")))
    n = partitions(spark, alive.agg(F.sum(length)).first()[0] or 0, TASK_TOKENS)
    salted = salted.select("node", "n", "copies", "tokens", "key", "salt").repartition(n, "key", "salt").sortWithinPartitions("key", "salt")
    clusters = cut(salted.mapInArrow(_clusters(num, den), "node long, n int, copies long, tokens binary, leader long, members int, links long"), "clusters")
    drop_cut(alive)
    lists = clusters.select("n", "tokens", "leader", "members").mapInArrow(_postings(num, den), "token long, leader long, members int, n int, rest int")
    # an index list holds each cluster once, however many of its sets have the token
    lists = cut(lists.groupBy("token", "leader").agg(F.max("members").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest")), "lists")
    long = small_side(cut(lists.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / LIST_PART).alias("parts")).where("parts > 1"), "long"))
    part = F.coalesce(F.pmod(F.xxhash64("leader"), F.col("parts")), F.lit(0).cast("long"))
    # part p of a list of k parts meets parts 0 to k - 1 in the cells (least, greatest) of the two
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1), lambda q: F.shiftleft(F.least(F.col("part"), q), 32).bitwiseOR(F.greatest(F.col("part"), q)))
    dealt = lists.join(long, "token", "left").withColumn("part", part).withColumn("cell", F.explode(cells)).select("token", "cell", "part", "leader", "members", "low", "high", "rest")
    dealt = dealt.repartition(n, "token", "cell").sortWithinPartitions("token", "cell")
    pairs = cut(dealt.mapInArrow(_candidates(num, den), "a long, b long").distinct(), "pairs")
    drop_cut(lists)
    sizes = cut(clusters.groupBy("leader").agg(F.sum(length).cast("long").alias("size"), F.count(F.lit(1)).alias("sets")), "sizes")
    weighed = pairs.join(sizes.withColumnRenamed("leader", "b"), "b")
    salts = cut(weighed.groupBy("a").agg(F.greatest(F.ceil(F.sum("size") / PAIR_TOKENS), F.ceil(F.sum("sets") / PAIR_SETS)).alias("salts"), F.sum("size").alias("asked")).join(sizes.withColumnRenamed("leader", "a"), "a"), "salts")
    asked = pairs.join(small_side(salts.where("salts > 1").select("a", "salts")), "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0).cast("long")))
    members = clusters.select("leader", "node", "n", "copies", "tokens")
    rows = ["a", "salt", "b", "head", "node", "n", "copies", "tokens"]
    own = asked.select("a", "salt").distinct().join(members, F.col("a") == F.col("leader")).withColumns({"b": F.lit(None).cast("long"), "head": F.lit(-1)}).select(rows)
    other = asked.select("a", "salt", "b").join(members, F.col("b") == F.col("leader")).withColumn("head", (F.col("node") != F.col("b")).cast("int")).select(rows)
    k = partitions(spark, salts.agg(F.sum(F.col("asked") + F.col("size") * F.col("salts"))).first()[0] or 0, TASK_TOKENS)
    found = cut(own.unionByName(other).repartition(k, "a", "salt").sortWithinPartitions("a", "salt").mapInArrow(_links(num, den), "u long, v long, node long, links long"), "links")
    joined = connected_components(found.where("u is not null").select("u", "v"))
    between = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("between"))
    label = clusters.select("node", "leader", "links").join(joined.withColumnRenamed("node", "leader"), "leader", "left").join(between, "node", "left")
    return label.select("node", F.coalesce("root", "leader").alias("group"), (F.col("links") + F.coalesce("between", F.lit(0))).alias("links"))


def _smallest_hash(tokens):
    import pandas as pd

    return pd.Series([int(tk.mix(np.frombuffer(t, np.uint64)).min().view(np.int64)) for t in tokens], dtype="int64")


def keep_first_of_component(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row of docs of each component, whole and with all columns: the one of smallest doc_id (and then text hash).

    Rows without a shingle and rows whose doc_id is null stay.  Rows of one
    doc_id and different texts are told apart: each stays or goes with its own
    component.  Of rows that are equal in doc_id and text one stays, if its
    text has a shingle.
    """
    shared_folder(docs.sparkSession)
    found = cut(_linked(only(docs, doc_id="long", text="string"), threshold).where("doc_id is not null and n_shingles > 0"), "found")
    row = F.struct("doc_id", "text_hash")
    first = cut(found.groupBy("group").agg(F.min(row).alias("first")), "first")
    away = cut(salted_join(found, first, "group").where(row != F.col("first")).select(F.col("doc_id").alias("_away"), F.col("text_hash").alias("_away_text")).distinct(), "away")
    twice = cut(found.groupBy(F.col("doc_id").alias("_twice"), F.col("text_hash").alias("_twice_text")).count().where("count > 1").drop("count"), "twice")
    same = lambda side, name: (docs["doc_id"].cast("long") == side[name]) & (F.xxhash64(docs["text"].cast("string")) == side[f"{name}_text"])
    away, twice = small_side(away), small_side(twice)
    rows = docs.join(away, same(away, "_away"), "left_anti")
    one = rows.join(twice, same(twice, "_twice"), "left_semi").withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"])
    return rows.join(twice, same(twice, "_twice"), "left_anti").unionByName(one.select(docs.columns)).select(docs.columns)

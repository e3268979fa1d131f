"""Belief propagation over arrays: the same sweeps, estimates and energy as ``propagation``, for large plain networks.

Nodes are dealt by hash into blocks; a block is one task, with all snapshots of its nodes and what its nodes hold of their
neighbours. A sweep is one job: each block gets its arrays and the messages that blocks sent it, a binary value for each two
blocks, computes by whole arrays, and sends on. Between two blocks both ends keep the pairs in one order, so that messages go
without keys. The state is written to the shared folder after every sweep, and read through Spark only.

A network whose messages have WHOLE values at most is one block. It hears of nobody, so the steps up to one whose energy is asked
for are one job, with all their sweeps and estimates, and the state is written after the last of them.

Other blocks have ROWS messages at most on the average. A node is in one block: one with tens of millions of neighbours needs a task that
holds them, about 150 bytes each, which the tables of ``propagation`` do not.
"""
from __future__ import annotations

import io
import pickle
import threading
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweft.functions import formulas as X
from netweft.plans.scratch import new_folder, passing, remove
from netweft.session import ship

#: Values of messages (one for each group) up to which a network is one block: 8 bytes each, held some five times over.
WHOLE = 8_000_000
#: Messages of a block of others, and the fewest for which another block, up to one for each core, is worth its task.
ROWS, FEW = 400_000, 20_000
#: Messages that a sweep takes at a time.
CHUNK = 1 << 15
#: Bytes that sweeps pass on before the driver lets go of the files of earlier ones.
HELD = 256 << 20
_ROW = "part int, kind string, other int, data binary, folder string"
_passed, _lock = [0], threading.Lock()

Matrix = Sequence[Sequence[float]]
#: alpha, pi, and beta by group, group and snapshot.
Params = tuple[np.ndarray, np.ndarray, np.ndarray]


def _batch(rows: list[tuple[int, str, int, bytes]]) -> pa.RecordBatch:
    part, kind, other, data = zip(*rows)
    arrays = [pa.array(part, pa.int32()), pa.array(kind, pa.string()), pa.array(other, pa.int32()), pa.array(data, pa.binary()), pa.array(kind, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "kind", "other", "data", "folder"])


def _softmax(x: np.ndarray) -> np.ndarray:
    top, total = x[0], 0.0  # groups are few: row by row is faster than along the axis
    for row in x[1:]:
        top = np.maximum(top, row)
    e = np.exp(x - top)
    for row in e:
        total = total + row
    e /= total
    return e


def _ln(x: np.ndarray, other: float) -> np.ndarray:
    """Logs, and ``other`` of what isn't positive."""
    good = x > 0
    if good.all():
        return np.log(x)
    return np.where(good, np.log(np.where(good, x, 1.0)), other)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.where(b > 0, b, 1.0), 0.0)


def _estimates(data: np.ndarray, q: int, times: int) -> Params:
    """What ``alpha_estimate``, ``pi_estimate`` and ``beta_estimate`` find, out of the sums that blocks counted."""
    n, shares, moves, size, edge = np.split(data, np.cumsum([1, q, q * q, q * times]))
    moves, size, edge = moves.reshape(q, q), size.reshape(q, -1), edge.reshape(q, q, -1)
    moves = _ratio(moves, moves.sum(axis=1, keepdims=True))
    cell = _ratio(edge, size[:, None] * size[None])
    cell = (cell + cell.transpose(1, 0, 2)) / 2
    for k in range(q):
        cell[k, k] = _ratio(edge[k, k].sum(), (size[k] ** 2).sum())
    return shares / n, moves, cell


def _energy(parts: np.ndarray, sums: np.ndarray, beta: np.ndarray) -> float:
    edge, time, site, n = parts
    return float((edge + time - site + np.einsum("rt,rkt,kt->", sums, beta, sums)) / n)


@dataclass(frozen=True)
class Rule:
    """Of the steps of a fit. energy: whether that of the last one is asked for; one that converges has it anyway."""

    tol: float
    msg_conv_tol: float
    conv_tol: float
    rate: float
    use_all: bool
    frozen: bool
    energy: bool

    def next(self, params: Params, change: float, counted: Callable[[], np.ndarray]) -> tuple[Params, float]:
        """Parameters after a step whose last sweep changed messages by ``change``, and how far they moved."""
        if self.frozen:
            return params, change
        found = _estimates(counted(), len(params[0]), params[2].shape[2])
        new = tuple(self.rate * x + (1 - self.rate) * old for x, old in zip(found, params))
        return new, float(max(np.abs(x - old).max() for x, old in zip(new, params)))


class _Block:
    """A block's arrays. net: node, t, nxt (the row of the node at t + 1, or -1) by node and time; row (of the receiver), on
    (whether the edge counts its way), mirror (the opposite message, of those within the block) and cut (where those of each
    block of senders begin), by message."""

    def __init__(self, part: int, q: int, net: dict[str, np.ndarray], state: np.ndarray | None, heard: dict[int, np.ndarray], said: dict[int, np.ndarray]):
        self.part, self.q, self.net = part, q, net
        self.node, self.t, self.nxt, self.row, self.on, self.mirror, self.cut = (net[k] for k in ("node", "t", "nxt", "row", "on", "mirror", "cut"))
        self.goes_on = np.flatnonzero(self.nxt >= 0)
        self.came = self.nxt[self.goes_on]
        if state is not None:
            self.w, self.fwd, self.bwd = state.reshape(3, q, -1)
            self.p = _softmax(self.w)
        self.psi, self.out = self._whole(heard), self._whole(said)
        if self.out is not None:  # the block's own came in the receivers' order
            a, b = self.cut[part : part + 2]
            self.out[:, a:b] = self.out[:, a:b][:, self.mirror]

    def _whole(self, pieces: dict[int, np.ndarray]) -> np.ndarray | None:
        if not pieces:
            return None
        whole = np.empty((self.q, len(self.row)))
        for k, x in pieces.items():
            whole[:, self.cut[k] : self.cut[k + 1]] = x.reshape(self.q, -1)
        return whole

    def sent(self, out: np.ndarray) -> list[tuple[int, str, int, bytes]]:
        rows = []
        for k in range(len(self.cut) - 1):
            a, b = self.cut[k : k + 2]
            if a < b:
                own = out[:, a:b]
                rows.append((self.part, "messages", k, np.ascontiguousarray(own[:, self.mirror] if k == self.part else own).tobytes()))
        return rows

    def at(self, times: np.ndarray) -> np.ndarray:
        return np.searchsorted(times, self.t)

    def by_time(self, times: np.ndarray) -> np.ndarray:
        """Sums of marginals by group and snapshot."""
        at = self.at(times)
        return np.stack([np.bincount(at, x, len(times)) for x in self.p])

    def _pass(self, by: np.ndarray, beta: np.ndarray, outside: np.ndarray, alpha: np.ndarray, pi: np.ndarray, tol: float) -> tuple[np.ndarray, float]:
        """Messages after a sweep, in the senders' order of the pairs, and their largest change; the nodes are then the new ones."""
        q, n, at, low = self.q, len(self.t), self.times_at, np.log(tol)
        out, site, change = np.empty_like(self.psi), np.zeros((q, n)), 0.0
        chunks = [slice(a, a + CHUNK) for a in range(0, len(by), CHUNK)]
        for c in chunks:  # the field first, in place of the message to come
            for k in range(q):
                out[k, c] = _ln(sum(self.psi[r, c] * np.take(beta[r, k], by[c]) for r in range(q)), low)
        for k in range(q):
            site[k] = np.bincount(self.row, out[k], n) - outside[k][at]
        ahead, back = np.zeros((q, n)), np.zeros((q, n))
        ahead[:, self.came] = _ln(pi.T @ np.take(self.fwd, self.goes_on, axis=1), 0.0)
        back[:, self.goes_on] = _ln(pi @ np.take(self.bwd, self.goes_on, axis=1), 0.0)
        start = np.log(alpha)[:, None]
        continues = np.zeros(n, bool)
        continues[self.came] = True
        pre = site + back + np.where(self.t == 0, start, 0.0)
        self.w = w = pre + np.where(self.t > 0, np.where(continues, ahead, start), 0.0)
        self.p = _softmax(w)
        self.fwd, self.bwd = np.full((2, q, n), np.nan)
        self.bwd[:, self.goes_on] = _softmax(np.take(pre, self.came, axis=1))
        self.fwd[:, self.goes_on] = _softmax(np.take(w - back, self.goes_on, axis=1))
        for c in chunks:
            out[:, c] = _softmax(np.take(w, self.row[c], axis=1) - out[:, c])
            change = max(change, np.abs(out[:, c] - self.out[:, c]).max())
        return out, change

    def told(self, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _batch([(self.part, "sums", 0, data.tobytes())])

    def state(self) -> np.ndarray:
        return np.stack([self.w, self.fwd, self.bwd])

    def sweep(self, times: np.ndarray, beta: np.ndarray, outside: np.ndarray, alpha: np.ndarray, pi: np.ndarray, tol: float) -> Iterator[pa.RecordBatch]:
        self.times_at = self.at(times)
        out, change = self._pass(self.times_at[self.row], beta, outside, alpha, pi, tol)
        yield _batch([(self.part, "sums", 0, np.concatenate([[change], self.by_time(times).ravel()]).tobytes())])
        yield _batch([(self.part, "nodes", 0, self.state().tobytes())])
        yield _batch(self.sent(out))

    def steps(self, times: np.ndarray, params: Params, plan: Sequence[int], rule: Rule) -> Iterator[pa.RecordBatch]:
        """What ``Packed.steps`` does, of a block that is the whole network."""
        self.times_at = self.at(times)
        by, told = self.times_at[self.row], []
        for k, most in enumerate(plan):
            alpha, pi, beta = params
            for _ in range(most):
                outside = np.einsum("rt,rkt->kt", self.by_time(times), beta)
                out, change = self._pass(by, beta, outside, alpha, pi, rule.tol)
                self.psi, self.out = np.take(out, self.mirror, axis=1), out
                if change < rule.msg_conv_tol:
                    break
            params, moved = rule.next(params, change, lambda: self.counted(times, beta, pi, rule.use_all))
            energy = None
            if moved < rule.conv_tol or (k == len(plan) - 1 and rule.energy):
                sums = self.by_time(times)
                energy = _energy(self.parted(times, params[2], params[1]), sums, params[2])
            told.append((params, moved, energy))
            if moved < rule.conv_tol:
                break
        yield _batch([(self.part, "sums", 0, pickle.dumps((told, self.by_time(times))))])
        yield _batch([(self.part, "nodes", 0, self.state().tobytes())])
        yield _batch(self.sent(self.out))

    def _pairs(self, times: np.ndarray, beta: np.ndarray) -> Iterator[tuple[slice, np.ndarray, list[list[np.ndarray]]]]:
        """(messages, their snapshots, what each two groups weigh on their edges), some messages at a time."""
        at, q = self.at(times), self.q
        for a in range(0, len(self.row), CHUNK):
            c = slice(a, a + CHUNK)
            by, psi, out = at[self.row[c]], self.psi[:, c], self.out[:, c]
            one = lambda r, k: psi[r] * out[k] + (psi[k] * out[r] if r != k else 0.0)
            yield c, by, [[one(r, k) * np.take(beta[r, k], by) for k in range(q)] for r in range(q)]

    def counted(self, times: np.ndarray, beta: np.ndarray, pi: np.ndarray, use_all: bool) -> np.ndarray:
        """Number and shares of rows that alpha counts, of pairs of groups in time, and by snapshot."""
        q = self.q
        edge = np.zeros((q, q, len(times)))
        for c, by, u in self._pairs(times, beta):
            on, total = self.on[c].astype(bool), sum(x for row in u for x in row)
            edge += np.array([[np.bincount(by[on], _ratio(x, total)[on], len(times)) for x in row] for row in u])
        g = self.fwd[:, None, self.goes_on] * self.bwd[None, :, self.goes_on] * pi[:, :, None]
        g = _ratio(g, g.sum(axis=(0, 1))).sum(axis=2)
        rows = np.ones(len(self.t), bool)
        if not use_all:
            rows[self.came[self.t[self.came] != 0]] = False
        data = np.concatenate([[rows.sum()], self.p[:, rows].sum(axis=1), g.ravel(), self.by_time(times).ravel(), edge.ravel()])
        assert len(data) == 1 + q + q * q + q * len(times) + q * q * len(times)
        return data

    def parted(self, times: np.ndarray, beta: np.ndarray, pi: np.ndarray) -> np.ndarray:
        """The energy's sums over edges, over time and over nodes, and the number of rows."""
        edge = sum(_ln(sum(x for row in u for x in row), 0.0).sum() for _, _, u in self._pairs(times, beta))
        time = _ln(np.einsum("rn,kn,rk->n", self.fwd[:, self.goes_on], self.bwd[:, self.goes_on], pi), 0.0).sum()
        top = self.w.max(axis=0)
        site = (top + np.log(np.exp(self.w - top).sum(axis=0))).sum()
        return np.array([edge, time, site, len(self.t)], float)

    def rows(self) -> Iterator[pa.RecordBatch]:
        gone = self.nxt < 0
        named = lambda name, x, mask=None: [(f"{name}{k}", pa.array(v, mask=mask)) for k, v in enumerate(x)]
        cols = [("node", pa.array(self.node)), ("t", pa.array(self.t)), *named("p", self.p), *named("fwd", self.fwd, gone), *named("bwd", self.bwd, gone), *named("w", self.w)]
        yield pa.RecordBatch.from_arrays([x for _, x in cols], names=[c for c, _ in cols])


def _packed(part: int, blocks: int, q: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """A block out of its rows: of nodes (no b), and of messages."""
    col = lambda x, name: x.column(name).to_numpy()
    own = table.filter(pa.compute.is_null(table.column("b")))
    order = np.lexsort((col(own, "t"), col(own, "a")))
    node, t = col(own, "a")[order], col(own, "t")[order]
    p = np.stack([col(own, f"v{k}")[order] for k in range(q)])
    follows = (node[1:] == node[:-1]) & (t[1:].astype(np.int64) == t[:-1].astype(np.int64) + 1)
    nxt = np.full(len(node), -1, np.int32)
    nxt[:-1][follows] = np.flatnonzero(follows) + 1

    rows = table.filter(pa.compute.is_valid(table.column("b")))
    recv, send, when, other = (col(rows, c) for c in ("a", "b", "t", "other"))
    low, high = np.minimum(recv, send), np.maximum(recv, send)
    order = np.lexsort((recv, high, low, when, other))
    opposite = np.lexsort((send, high, low, when, other))
    cut = np.searchsorted(other[order], np.arange(blocks + 1))
    a, b = cut[part : part + 2]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    mirror = np.empty(b - a, np.int32)
    mirror[place[opposite[a:b]] - a] = np.arange(b - a)
    recv, when = recv[order], when[order]
    # Rows of (recv, t): nodes are few beside messages, so their numbers come by two searches.
    names, first = np.unique(node, return_index=True)
    at = np.searchsorted(names, recv)
    low_t = int(t.min()) if len(t) else 0
    span = int(t.max()) - low_t + 1 if len(t) else 1
    keys = np.searchsorted(names, node) * span + (t.astype(np.int64) - low_t)
    row = np.searchsorted(keys, at * span + (when.astype(np.int64) - low_t)).astype(np.int32)
    lost = (row >= len(node)) | (at >= len(names))
    if lost.any() or (node[row] != recv).any() or (t[row] != when).any() or (np.bincount(row, minlength=len(node)) == 0).any():
        raise ValueError("arrays need a label for every row of the network, and for no other")
    held = io.BytesIO()
    np.savez(held, node=node, t=t, nxt=nxt, row=row, on=col(rows, "w")[order] > 0, mirror=mirror, cut=cut)
    yield _batch([(part, "net", 0, held.getvalue())])
    state = np.full((3, q, len(node)), np.nan)
    with np.errstate(divide="ignore"):
        state[0] = np.log(p)
    state[1][:, nxt >= 0] = p[:, nxt >= 0]
    state[2][:, nxt >= 0] = p[:, nxt[nxt >= 0]]
    yield _batch([(part, "nodes", 0, state.tobytes())])
    psi = np.stack([col(rows, f"v{k}")[order] for k in range(q)])
    pieces = [(k, psi[:, cut[k] : cut[k + 1]]) for k in range(blocks) if cut[k] < cut[k + 1]]
    yield _batch([(k, "messages", part, np.ascontiguousarray(x).tobytes()) for k, x in pieces])
    times = np.unique(t)
    sums = np.array([[p[k][t == x].sum() for k in range(q)] for x in times])
    yield _batch([(part, "sums", 0, np.column_stack([times.astype(float), sums]).tobytes())])


class Packed:
    """The network of a fit as arrays, with its messages and nodes at the start (``first``)."""

    def __init__(self, messages: DataFrame, nodes: DataFrame, q: int):
        self.spark, self.q = messages.sparkSession, q
        ship(self.spark)
        n = messages.count()
        cores = self.spark.sparkContext.defaultParallelism
        self.blocks = blocks = 1 if n * q <= WHOLE else min(cores * max(1, -(-n // (ROWS * cores))), n // FEW + 1)
        self.bytes = n * (16 * q + 5)
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        told = messages.select(part("recv").alias("part"), "t", F.col("recv").alias("a"), F.col("send").alias("b"), part("send").alias("other"), F.col("w_fwd").alias("w"), *(F.col(f"psi{k}").alias(f"v{k}") for k in range(q)))
        own = nodes.select(part("node").alias("part"), "t", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0).alias("other"), F.lit(1.0).alias("w"), *(F.col(f"p{k}").alias(f"v{k}") for k in range(q)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if held and sum(x.num_rows for x in held):
                table = pa.Table.from_batches(held)
                for k in sorted(set(table.column("part").to_pylist()) if blocks > 1 else {0}):
                    yield from _packed(k, blocks, q, table.filter(pa.compute.equal(table.column("part"), k)))

        uri = self._write(told.unionByName(own).repartitionById(blocks, "part").mapInArrow(pack, _ROW))
        self.net = f"{uri}/folder=net"
        self.first = f"{uri}/folder=messages", f"{uri}/folder=nodes"
        every: dict[int, np.ndarray] = {}
        for x in self._sums(uri):
            for row in np.frombuffer(x).reshape(-1, q + 1):
                every[int(row[0])] = every.get(int(row[0]), 0.0) + row[1:]
        self.times = np.array(sorted(every), np.int64)
        self.sums = np.stack([every[t] for t in sorted(every)], axis=1)

    def _write(self, rows: DataFrame) -> str:
        uri = new_folder(self.spark, "packed")
        rows.write.option("compression", "uncompressed").partitionBy("folder").parquet(uri)
        return passing(self.spark, uri)

    def _read(self, *uris: str) -> DataFrame:
        return self.spark.read.schema("part int, kind string, other int, data binary").parquet(*uris)

    def _sums(self, uri: str) -> list[bytes]:
        rows = self._read(f"{uri}/folder=sums").collect()
        remove(self.spark, f"{uri}/folder=sums")
        return [bytes(r["data"]) for r in sorted(rows, key=lambda r: r["part"])]

    def _map(self, messages: str | None, nodes: str, work: Callable[[_Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        q, alone = self.q, self.blocks == 1
        rows = self._read(self.net, nodes, *([messages] if messages else []))
        if messages and not alone:  # each goes to its receiver, and back to its sender for the change that the next makes
            ends = "array(named_struct('part', other, 'kind', 'heard', 'other', part), named_struct('part', part, 'kind', 'said', 'other', other))"
            rows = rows.selectExpr("data", f"explode(CASE WHEN kind = 'messages' THEN {ends} ELSE array(named_struct('part', part, 'kind', kind, 'other', other)) END) AS x").selectExpr("x.*", "data")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, dict] = {}
            for batch in batches:
                for part, kind, other, data in zip(*(batch.column(c) for c in ("part", "kind", "other", "data"))):
                    at = held.setdefault(part.as_py(), {"net": {}, "nodes": {}, "messages": {}, "heard": {}, "said": {}})
                    at[kind.as_py()][other.as_py()] = data.as_buffer()
            for part in sorted(held):
                x = held.pop(part)
                arrays = [{k: np.frombuffer(v) for k, v in x["messages" if alone else way].items()} for way in ("heard", "said")]
                with np.load(io.BytesIO(x["net"][0])) as net:
                    block = _Block(part, q, {k: net[k] for k in net.files}, np.frombuffer(x["nodes"][0]), *arrays)
                with np.errstate(divide="ignore"):
                    yield from work(block)

        return rows.repartitionById(self.blocks, "part").mapInArrow(run, schema)

    def params(self, alpha: Sequence[float], pi: Matrix, beta: dict[int, Matrix]) -> Params:
        return np.array(alpha, float), np.array(pi, float), np.array([beta[int(t)] for t in self.times], float).transpose(1, 2, 0)

    def _collected(self, rows: DataFrame) -> np.ndarray:
        return sum(np.frombuffer(bytes(r["data"])) for r in sorted(rows.select("part", "data").collect(), key=lambda r: r["part"]))

    def _pass(self) -> None:
        """Files of shuffles go when the driver's JVM finds that nobody refers to them."""
        with _lock:
            _passed[0] += self.bytes
            if _passed[0] < HELD:
                return
            _passed[0] = 0
        self.spark._jvm.System.gc()

    def steps(self, messages: str, nodes: str, alpha: Sequence[float], pi: Matrix, beta: dict[int, Matrix], plan: Sequence[int], rule: Rule, kept: Collection[str] = ()) -> tuple[str, str, list[tuple]]:
        """``(messages, nodes, [(alpha, pi, beta, how far they moved, energy or None) of each step])``.

        plan: the most sweeps of each step, which ends before as soon as messages change by less than the rule's bound; the last
        step is the one that converges, if any. What goes in is removed, except for nodes that are among ``kept``.
        """
        params, times, told = self.params(alpha, pi, beta), self.times, []
        if self.blocks == 1:
            uri = self._write(self._map(messages, nodes, lambda block: block.steps(times, params, plan, rule), _ROW))
            told, self.sums = pickle.loads(self._sums(uri)[0])
            remove(self.spark, messages, *(() if nodes in kept else (nodes,)))
            messages, nodes = f"{uri}/folder=messages", f"{uri}/folder=nodes"
            self._pass()
        for k, most in enumerate(plan if self.blocks > 1 else ()):
            for _ in range(most):
                new, swept, change = self.sweep(messages, nodes, params, rule.tol)
                remove(self.spark, messages, *(() if nodes in kept else (nodes,)))
                messages, nodes = new, swept
                if change < rule.msg_conv_tol:
                    break
            params, moved = rule.next(params, change, lambda: self._counted(messages, nodes, params, rule.use_all))
            ends = moved < rule.conv_tol
            told.append((params, moved, self.energy(messages, nodes, params) if ends or (k == len(plan) - 1 and rule.energy) else None))
            if ends:
                break
        named = lambda x: {**beta, **{int(t): x[:, :, i].tolist() for i, t in enumerate(times)}}
        return messages, nodes, [(a.tolist(), p.tolist(), named(b), moved, energy) for (a, p, b), moved, energy in told]

    def sweep(self, messages: str, nodes: str, params: Params, tol: float) -> tuple[str, str, float]:
        """``(messages, nodes, largest change of a message)`` after a sweep."""
        times, (a, p, b) = self.times, params
        outside = np.einsum("rt,rkt->kt", self.sums, b)
        uri = self._write(self._map(messages, nodes, lambda block: block.sweep(times, b, outside, a, p, tol), _ROW))
        found = np.stack([np.frombuffer(x) for x in self._sums(uri)])
        self.sums = found[:, 1:].sum(axis=0).reshape(self.q, -1)
        self._pass()
        return f"{uri}/folder=messages", f"{uri}/folder=nodes", float(found[:, 0].max())

    def _counted(self, messages: str, nodes: str, params: Params, use_all: bool) -> np.ndarray:
        times, (_, p, b) = self.times, params
        return self._collected(self._map(messages, nodes, lambda block: block.told(block.counted(times, b, p, use_all)), _ROW))

    def energy(self, messages: str, nodes: str, params: Params) -> float:
        times, (_, p, b) = self.times, params
        parts = self._collected(self._map(messages, nodes, lambda block: block.told(block.parted(times, b, p)), _ROW))
        return _energy(parts, self.sums, b)

    def rows(self, nodes: str) -> DataFrame:
        """The node table: (node, t, p0.., fwd0.., bwd0.., w0..)."""
        schema = "node long, t int, " + ", ".join(f"{c} double" for x in ("p", "fwd", "bwd", "w") for c in X.cols(x, self.q))
        return self._map(None, nodes, lambda block: block.rows(), schema)

    def close(self) -> None:
        remove(self.spark, self.net)

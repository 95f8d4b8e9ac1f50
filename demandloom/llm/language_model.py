"""Log-likelihood of whole texts under a gated recurrent word model whose output is factored into a chain of small choices."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.checkpoints import work_dir
from .arrays import BLANK, slices, text_arrays, word_hashes
from .components import stored

END = np.uint64(0)
STATE = 24
KNOWN_WORDS = HEAD = 65_536
FAN = 16
LANES, WINDOW_TOKENS, BACK = 512, 16_384, 16
FULL_WINDOW = 2048
GROUP_TOKENS = 2_500_000
SHARED = ("uzr", "un", "ws", "bs", "wc", "bc")


def factored(words: int) -> tuple[int, int]:
    """Number of classes and of members that hold so many words: both about its square root, in whole groups of ``FAN``."""
    classes = -(-int(np.ceil(np.sqrt(words))) // FAN) * FAN
    return classes, -(-words // (classes * FAN)) * FAN


def shapes(classes: int, members: int) -> dict[str, tuple[int, ...]]:
    """Input rows and the gates; weights and biases of the groups of classes, of the classes and the tail, of the groups in a class, of the words."""
    return {"x": (classes * members + 1, 3 * STATE), "uzr": (STATE, 2 * STATE), "un": (STATE, STATE), "ws": (classes // FAN, STATE), "bs": (classes // FAN,),
            "wc": (classes + 1, STATE), "bc": (classes + 1,), "wg": (classes, members // FAN, STATE), "bg": (classes, members // FAN),
            "ww": (classes, members, STATE), "bw": (classes, members)}


def first_parameters(counts: np.ndarray, tail: float) -> dict[str, np.ndarray]:
    """Small random weights; biases that make an empty state predict the unigram shares of head words and of the tail.

    ``counts`` of the head words fall, so each class holds words of like frequency.
    """
    rng = np.random.default_rng(7)
    classes, members = factored(len(counts))
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes(classes, members).items()}
    full = np.zeros(classes * members)
    full[: len(counts)] = counts
    by_class = full.reshape(classes, members)
    by_group = by_class.reshape(classes, -1, FAN).sum(2)
    p["bw"] = np.where(by_class > 0, np.log(np.maximum(by_class, 1)), -1e9).astype(np.float32)
    for k, mass in (("bs", by_class.reshape(-1, FAN * members).sum(1)), ("bc", np.append(by_class.sum(1), tail)), ("bg", by_group)):
        p[k] = np.log(np.maximum(mass, 1e-9)).astype(np.float32)
    for k in ("ws", "wc", "wg", "ww"):
        p[k] *= 0.1
    return p


def sigmoid(a: np.ndarray) -> np.ndarray:
    """One over one plus exp(-a); ``a`` is used up."""
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    return np.reciprocal(a, out=a)


def picked(a: np.ndarray, at: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log softmax of each row of ``a`` at one place, and with ``slope`` the gradient of its negative; ``a`` may change."""
    rows = np.arange(len(a))
    # Sums of exponentials stay far inside the range of floats for usual weights; else the largest value of each row is taken off first.
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(a)
        total = e @ np.ones(a.shape[1], a.dtype)
    if not ((total > 1e-20) & (total < 1e20)).all():
        a -= a.max(1, keepdims=True)
        e = np.exp(a)
        total = e.sum(1)
    got = a[rows, at] - np.log(total)
    if not slope:
        return got, None
    e *= (1 / total)[:, None]
    e[rows, at] -= 1
    return got, e


def afresh(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The states, with those of lanes where a text starts set to zero."""
    if start.any():
        h = h.copy()
        h[start] = 0
    return h


def step(p: dict, h: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    a = np.take(p["x"], word, 0)
    zr = h @ p["uzr"]
    zr += a[:, : 2 * STATE]
    zr = sigmoid(zr)
    z, r = zr[:, :STATE], zr[:, STATE:]
    n = (r * h) @ p["un"]
    n += a[:, 2 * STATE :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n


@dataclass
class Moved:
    """Gradients of the groups of ``FAN`` rows that were met; ``groups`` counts them over all classes."""

    groups: np.ndarray
    w: np.ndarray
    b: np.ndarray
    in_class: int

    def __iter__(self) -> Iterator[np.ndarray]:
        return iter((self.groups, self.w, self.b))

    def items(self) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
        """Places (class, row of the class) and the gradients there."""
        yield (self.groups[:, None] // self.in_class, self.groups[:, None] % self.in_class * FAN + np.arange(FAN)), (self.w, self.b)


def choice(
    w: np.ndarray, b: np.ndarray, group: np.ndarray, chosen: np.ndarray, states: np.ndarray, got: np.ndarray, back: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Log probability of each token's choice among the rows of its group, added to ``got``; with ``back``, the groups met and their gradients.

    ``group`` rises; ``states`` has one more row, of zeros. Groups with about as many tokens are multiplied together, filled up with that row.
    """
    n = len(group)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    count = np.diff(np.append(first, n))
    width = 2 ** np.ceil(np.log2(count)).astype(np.int64)
    by_width = np.argsort(width, kind="stable")
    first, count, width = first[by_width], count[by_width], width[by_width]
    met = group[first]
    here, bias = np.take(w, met, 0), b[met, None]
    edges = [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), len(met)]
    a, parts = np.empty((n + 1, w.shape[1]), states.dtype), []
    for lo, hi in zip(edges, edges[1:]):
        k, size = slice(lo, hi), int(width[lo])
        rows = first[k, None] + np.arange(size)
        rows[np.arange(size) >= count[k, None]] = n
        x = np.take(states, rows, 0)
        logits = x @ here[k].transpose(0, 2, 1)
        logits += bias[k]
        a[rows] = logits
        parts.append((k, rows, x))
    inner, d = picked(a[:n], chosen, back is not None)
    got += inner
    if back is None:
        return None
    a[:n], a[n] = d, 0
    gw, gb, pushed = np.empty_like(here), np.empty((len(met), w.shape[1]), a.dtype), np.empty((n + 1, STATE), a.dtype)
    for k, rows, x in parts:
        d = np.take(a, rows, 0)
        np.matmul(d.transpose(0, 2, 1), x, out=gw[k])
        np.sum(d, 1, out=gb[k])
        pushed[rows] = d @ here[k]
    back += pushed[:n]
    return met, gw, gb


def output(p: dict, states: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target (head word, or the tail as a whole) given its state; fills ``grads`` if asked to, with
    those of the words' groups met under ``members`` and of the classes' groups under ``groups``.

    Four choices lead to a word: a group of classes (or the tail), a class, a group of its members, the word.
    """
    classes, members = p["bw"].shape
    order = np.argsort(target)
    t = target[order]
    n = int(np.searchsorted(t, classes * members))  # the tail comes last
    s = np.zeros((len(t) + 1, STATE), states.dtype)
    np.take(states, order, 0, out=s[:-1])
    w, b = np.concatenate((p["ws"], p["wc"][-1:])), np.concatenate((p["bs"], p["bc"][-1:]))
    inner, d = picked(s[:-1] @ w.T + b, t // (members * FAN), grads is not None)
    pushed = None if grads is None else d @ w
    if grads is not None:
        gw, gb = d.T @ s[:-1], d.sum(0)
        gwc, gbc = np.zeros_like(p["wc"]), np.zeros_like(p["bc"])
        gwc[-1], gbc[-1] = gw[-1], gb[-1]
        grads |= {"ws": gw[:-1], "bs": gb[:-1], "wc": gwc, "bc": gbc}
    if n:
        t, s, here, down = t[:n], s[: n + 1], inner[:n], None if pushed is None else pushed[:n]
        s[n] = 0
        choices = (
            choice(p["wc"][:-1].reshape(-1, FAN, STATE), p["bc"][:-1].reshape(-1, FAN), t // (members * FAN), t // members % FAN, s, here, down),
            choice(p["wg"], p["bg"], t // members, t % members // FAN, s, here, down),
            choice(p["ww"].reshape(-1, FAN, STATE), p["bw"].reshape(-1, FAN), t // FAN, t % FAN, s, here, down),
        )
        if grads is not None:
            (met, gw, gb), grads["groups"], words = choices
            gwc[:-1].reshape(-1, FAN, STATE)[met], gbc[:-1].reshape(-1, FAN)[met] = gw, gb
            grads["members"] = Moved(*words, members // FAN)
    got, back = np.empty_like(inner), None if pushed is None else np.empty_like(pushed)
    got[order] = inner
    if back is not None:
        back[order] = pushed
    return got, back


def lanes(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane and first step of every text, longest first to the least filled lane; the number of steps of each lane, falling.

    As many lanes as the longest text leaves evenly filled; where lanes are over, the others go on without them.
    """
    count = int(np.clip(lengths.sum() // max(int(lengths.max()), 1), 1, most))
    heap = [(0, i) for i in range(count)]
    lane, begin = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        at, k = heapq.heappop(heap)
        lane[i], begin[i] = k, at
        heapq.heappush(heap, (at + int(lengths[i]), k))
    steps, order = zip(*sorted(((n, k) for n, k in heap if n), key=lambda x: (-x[0], x[1])))
    place = np.zeros(count, np.int64)
    place[list(order)] = np.arange(len(order))
    return place[lane], begin, np.array(steps)


def laid_out(tokens: np.ndarray, lengths: np.ndarray, end_word: int, most: int) -> tuple[np.ndarray, ...]:
    """Input word, target word (-1 where a lane is over), text and start flag by step and lane; the steps of each lane."""
    lane, begin, filled = lanes(lengths, most)
    steps, count = int(filled[0]), len(filled)
    text = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    at = (begin[text] + np.arange(len(tokens)) - first[text]) * count + lane[text]
    target, owner = np.full(steps * count, -1, np.int32), np.zeros(steps * count, np.int32)
    target[at], owner[at] = tokens, text
    start = np.zeros(steps * count, bool)
    start[at[first]] = True
    target, start = target.reshape(steps, count), start.reshape(steps, count)
    source = np.full_like(target, end_word)
    source[1:] = np.maximum(target[:-1], 0)
    source[start] = end_word
    return source, target, owner.reshape(steps, count), start, filled


def text_scores(p: dict, tokens: np.ndarray, lengths: np.ndarray, end_word: int) -> np.ndarray:
    """Natural log probability of each text; the state runs through all windows of a text and starts afresh with the next one."""
    source, target, owner, start, filled = laid_out(tokens, lengths, end_word, LANES)
    total, h, a = np.zeros(len(lengths)), np.zeros((target.shape[1], STATE), np.float32), 0
    while a < len(target):
        count = int((filled > a).sum())
        part = slice(a, min(a + max(BACK, WINDOW_TOKENS // count), len(target)))
        h = h[:count]
        states = np.empty((part.stop - a, count, STATE), np.float32)
        for i in range(a, part.stop):
            h = afresh(h, start[i, :count])
            h = states[i - a] = step(p, h, source[i, :count])[0]
        words = target[part, :count]
        live = words >= 0
        got, _ = output(p, states[live], words[live])
        total += np.bincount(owner[part, :count][live], got, len(lengths))
        a = part.stop
    return total


def train(p: dict, tokens: np.ndarray, lengths: np.ndarray, end_word: int, rate: float = 0.01, rare_rate: float = 0.1) -> dict:
    """Parameters after one pass: back-propagation through windows of 16 steps, the state carried from window to window.

    Input rows move only when their word is read. Members of a class and their groups move by the sum of their gradients over the root of
    one plus their mean squares so far, so a word that a task does not meet keeps its share and is not pushed down step by step.
    """
    p = {k: v.copy() for k, v in p.items()}
    m, v, k = {x: np.zeros_like(p[x]) for x in (*SHARED, "x")}, {x: np.zeros_like(p[x]) for x in (*SHARED, "x")}, 0
    flat = {"groups": (p["wg"], p["bg"]), "members": (p["ww"].reshape(-1, FAN, STATE), p["bw"].reshape(-1, FAN))}
    squares = {x: np.ones_like(b) for x, (_, b) in flat.items()}
    sources, targets, _, starts, filled = laid_out(tokens, lengths, end_word, LANES)
    h = np.zeros((targets.shape[1], STATE), np.float32)
    for a in range(0, len(targets), BACK):
        count = int((filled > a).sum())
        source, target, start, h = sources[:, :count], targets[:, :count], starts[:, :count], h[:count]
        stop = min(a + BACK, len(target))
        kept, states = [], []
        for i in range(a, stop):
            h = afresh(h, start[i])
            new, z, r, n = step(p, h, source[i])
            kept.append((h, z, r, n))
            states.append(new)
            h = new
        live = target[a:stop] >= 0
        if not live.any():
            continue
        grads: dict[str, np.ndarray] = {}
        learned = target[a:stop][live]
        _, back = output(p, np.stack(states)[live], learned, grads)
        down = np.zeros((stop - a, len(h), STATE), np.float32)
        down[live] = back
        inputs = np.empty((stop - a, len(h), 3 * STATE), np.float32)
        old, z, r, n = (np.stack(x) for x in zip(*kept))
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (old - n) * z * (1 - z), old * r * (1 - r)
        dh = np.zeros_like(h)
        for i in range(stop - a - 1, -1, -1):
            d, dzr, dn = dh + down[i], inputs[i, :, : 2 * STATE], inputs[i, :, 2 * STATE :]
            np.multiply(d, by_n[i], out=dn)
            drh = dn @ p["un"].T
            np.multiply(d, by_z[i], out=dzr[:, :STATE])
            np.multiply(drh, by_r[i], out=dzr[:, STATE:])
            dh = dzr @ p["uzr"].T
            dh += d * z[i]
            dh += drh * r[i]
            dh = afresh(dh, start[a + i])
        rows = inputs.reshape(-1, 3 * STATE)
        guzr, gun = old.reshape(-1, STATE).T @ rows[:, : 2 * STATE], (r * old).reshape(-1, STATE).T @ rows[:, 2 * STATE :]
        word = source[a:stop].ravel()
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(word[order]) != 0)))
        grads |= {"x": np.add.reduceat(np.take(rows, order, 0), first), "uzr": guzr, "un": gun}
        share = min(1.0, len(learned) / FULL_WINDOW)  # a few lanes that run on alone move little
        k += 1
        for x in (*SHARED, "x"):
            at = word[order[first]] if x == "x" else ...
            g = grads[x]
            g *= np.float32(1 / len(learned))
            mean, power = (np.take(y[x], at, 0) if x == "x" else y[x].copy() for y in (m, v))
            mean *= np.float32(0.9)
            power *= np.float32(0.99)
            mean += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.01)
            power += g
            m[x][at], v[x][at] = mean, power
            power *= np.float32(1 / (1 - 0.99**k))
            np.sqrt(power, out=power)
            power += np.float32(1e-8)
            mean *= np.float32(rate * share / (1 - 0.9**k))
            mean /= power
            p[x][at] -= mean
        for x, (weights, biases) in flat.items() if "members" in grads else ():
            met, g, b = grads[x]
            power = squares[x][met] = squares[x][met] + b * b + np.einsum("ijk,ijk->ij", g, g) / STATE
            size = np.float32(rare_rate) / np.sqrt(power)
            biases[met] -= size * b
            g *= size[:, :, None]
            weights[met] -= g
    return p


def block_views(p: dict, block: int) -> list[np.ndarray]:
    """The parameters of a class (input rows first), or, after the last class, the tail's input row and what all words share."""
    classes, members = p["bw"].shape
    if block == classes:
        return [p["x"][-1], *(p[x] for x in SHARED)]
    return [p["x"][block * members : (block + 1) * members], p["ww"][block], p["bw"][block], p["wg"][block], p["bg"][block]]


def block_weights(n: np.ndarray, block: int, shape: tuple[int, int]) -> np.ndarray:
    """Weight of each number of a block from its token counts: one per member, or those of the tail and of all words."""
    classes, members = shape
    if block == classes:
        shared = sum(int(np.prod(shapes(*shape)[x])) for x in SHARED)
        return np.concatenate((np.repeat(n[0], 3 * STATE), np.repeat(n[1], shared)))
    return np.concatenate((np.repeat(n, 3 * STATE), np.repeat(n.sum(), (members + members // FAN) * (STATE + 1))))


def get_block(p: dict, block: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    classes, members = p["bw"].shape
    n = np.array([times[-1], times.sum()]) if block == classes else times[block * members : (block + 1) * members]
    return n.astype(np.float64), np.concatenate([x.ravel() for x in block_views(p, block)]).astype(np.float32)


def put_block(p: dict, block: int, n: np.ndarray, value: np.ndarray) -> None:
    """Overwrite what has been trained."""
    trained, at = block_weights(n, block, p["bw"].shape) > 0, 0
    for view in block_views(p, block):
        new, given = (x[at : at + view.size].reshape(view.shape) for x in (value, trained))
        view[given] = new[given]
        at += view.size


def averaged(batches, shape: tuple[int, int]):
    """The mean of each block over its rows by tokens; all rows of a block are in the same partition."""
    totals: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, n, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n = np.frombuffer(n)
            part = np.frombuffer(value, np.float32) * block_weights(n, block, shape)
            if block in totals:
                totals[block][0] += n
                totals[block][1] += part
            else:
                totals[block] = [n.copy(), part]
    for block, (n, total) in totals.items():
        value = (total / np.maximum(block_weights(n, block, shape), 1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n.tobytes()]), pa.array([value.tobytes()])], names=["block", "n", "v"])


def document_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, each text followed by the end token, and the number of tokens of each."""
    data, bounds = text_arrays(column)
    words, row = word_hashes(data, bounds, BLANK)
    n = np.bincount(row, minlength=len(bounds) - 1).astype(np.int64)
    out = np.full(len(words) + len(n), END, np.uint64)
    out[np.arange(len(words)) + row] = words
    return out, n + 1


def place(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each hash in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return at, table[at] == hashes


def score_texts(
    records: DataFrame, training: Column, key: str = "SKU", text: str = "Product_Name", rounds: int = 1,
) -> DataFrame:
    """Log10 probability of every whole item text: (key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``).

    Tokens are the words between blanks (A-Z as a-z) and one end per text. ``training`` marks the rows that may teach; counts of
    all their words give the base score, the sum of log10((c + 0.5) / (N + 0.5 (V + 1))). The model knows the 65,536 commonest words
    singly, each with an input row of its own; all others form its tail. A gated recurrent unit of 24 cells reads the text; the output
    is factored into the tail and classes of words of like counts, as many classes as members, and a word's probability into that
    of its class and its share in it. Both are reached by two choices among 16: groups of classes, then classes; groups of members, then words. A tail word has the tail's probability times (c + 0.5) over the tail's sum of these (unseen
    words together count 0.5), so both scores spread over the same events.

    Words count as equal if 64-bit hashes agree. In each of ``rounds`` rounds every partition trains on all its training texts with
    truncated back-propagation, and the parameters are averaged: input rows by the tokens of their word, a class by those of its
    words, the others by all tokens. Tasks take ``GROUP_TOKENS`` tokens or a partition, whichever is more. Training and scoring carry the state across windows to
    the end of a text, however long. Counts of the 65,536 commonest words go with the tasks; those of other words are joined.

    A null text counts as empty: one end token. A null ``training`` counts as true. Repeated rows and null keys are scored
    like any other. Without training rows all counts are 0. An empty table gives no rows; other columns are dropped.
    """
    spark = records.sparkSession
    root = work_dir(spark)
    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(training, F.lit(True)).alias("train"))
    teach = rows.where("train").select("text")

    def counted(batches):
        for batch in slices(batches, "text"):
            h, n = np.unique(document_tokens(batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = stored(teach.mapInArrow(counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), root, "counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "h").limit(KNOWN_WORDS).toArrow()
    common, common_n = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.float64)
    if (common == END).any():
        head, head_n = common, common_n
    else:
        head, head_n = np.append(common[: HEAD - 1], END), np.append(common_n[: HEAD - 1], 0.0)
    tail_mass = float(n_all - head_n.sum()) + 0.5 * (v_all - int((head_n > 0).sum()) + 1)
    by_hash, by_common = np.argsort(head), np.argsort(common)
    tail_word = int(np.prod(factored(len(head))))
    at, inside = place(head[by_hash], common[by_common])
    facts = {
        "common": common[by_common], "common_n": common_n[by_common], "word": np.where(inside, by_hash[at], tail_word).astype(np.int32),
        "end": int(np.flatnonzero(head == END)[0]), "total": n_all + 0.5 * (v_all + 1), "tail_mass": tail_mass, "tail": tail_word,
    }
    sent = spark.sparkContext.broadcast(facts)

    def words_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word of the model, place among the common words, and whether it is one of them."""
        facts = sent.value
        at, known = place(facts["common"], hashes)
        word = np.full(len(hashes), facts["tail"], np.int32)
        word[known] = facts["word"][at[known]]
        word[hashes == END] = facts["end"]
        return word, at, known

    p = first_parameters(np.maximum(head_n, 0.5), tail_mass)
    classes, members = p["bw"].shape
    some = teach.where("text IS NOT NULL").coalesce(max(1, -(-int(n_all) // GROUP_TOKENS)))
    block = "block int, n binary, v binary"
    for _ in range(rounds if n_all else 0):
        now = spark.sparkContext.broadcast(p)

        def trained(batches, now=now):
            current, times = now.value, np.zeros(classes * members + 1)
            for batch in slices(batches, "text"):
                hashes, lengths = document_tokens(batch.column("text"))
                word = words_of(hashes)[0]
                current = train(current, word, lengths, sent.value["end"])
                times += np.bincount(word, minlength=len(times))
            for c in np.flatnonzero(times[:-1].reshape(classes, members).sum(1)).tolist() + [classes] * bool(times.any()):
                n, value = get_block(current, c, times)
                columns = [pa.array([c], pa.int32()), pa.array([n.tobytes()]), pa.array([value.tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "n", "v"])

        # One block for each class and one for what all share; the mean of a block is taken where its rows meet.
        means = some.mapInArrow(trained, block).repartition("block").mapInArrow(lambda batches: averaged(batches, (classes, members)), block)
        p = {k: v.copy() for k, v in p.items()}
        for row in means.toArrow().to_pylist():
            put_block(p, row["block"], np.frombuffer(row["n"]), np.frombuffer(row["v"], np.float32))
    final = spark.sparkContext.broadcast(p)

    fields = {"id": T.StringType(), "key": records.schema[key].dataType, "train": T.BooleanType(), "n_tokens": T.LongType(), "n_known": T.LongType(),
              "base": T.DoubleType(), "model": T.DoubleType(), "n_rest": T.LongType(), "h": T.LongType(), "times": T.LongType()}
    schema = T.StructType([T.StructField(k, t) for k, t in fields.items()])

    def scored(batches):
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number
            facts = sent.value
            hashes, lengths = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            n, text_of = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
            word, at, known = words_of(hashes)
            model = text_scores(final.value, word, lengths, facts["end"]) / np.log(10)
            logs = np.zeros(len(hashes))
            logs[known] = np.log10(facts["common_n"][at[known]] + 0.5)
            base = np.bincount(text_of[known], logs[known] - np.log10(facts["total"]), n)
            tail = known & (word == facts["tail"])
            model += np.bincount(text_of[tail], logs[tail] - np.log10(facts["tail_mass"]), n)
            n_known = np.bincount(text_of[known], minlength=n)
            ids = [f"{part}-{number + i}" for i in range(n)]
            number += n
            columns = [pa.array(ids), pa.concat_arrays([x[0].column("key") for x in held]), pa.concat_arrays([x[0].column("train") for x in held]), pa.array(lengths),
                       pa.array(n_known), pa.array(base.astype(float)), pa.array(model.astype(float)), pa.array(lengths - n_known), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            order = np.lexsort((hashes[~known], text_of[~known]))
            rest, owner = hashes[~known][order], text_of[~known][order]
            if len(rest):
                new = np.concatenate(([True], (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1])))
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rest)))
                blank = [pa.nulls(len(first), x) for x in (held[0][0].column("key").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                columns = [pa.array(ids).take(pa.array(owner[first])), *blank, pa.array(rest[first].view(np.int64)), pa.array(times)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in slices(batches, "text", 4 << 20):
            hashes, lengths = document_tokens(batch.column("text"))
            held.append((batch.select(["key", "train"]), hashes, lengths))
            size += len(hashes)
            if size >= GROUP_TOKENS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    both = stored(rows.mapInArrow(scored, schema), root, "scored")
    # Words outside the common ones: at most as frequent as the last of those, so no key is hot.
    rest = both.where("h IS NOT NULL").select("id", "h", "times").join(counts, "h", "left")
    c = F.coalesce("n", F.lit(0))
    rest = rest.groupBy("id").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"))
    out = both.where("h IS NULL").drop("h", "times").join(rest, "id", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        F.col("key").alias(key), (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_rest") * float(np.log10(facts["total"]))).alias("base_score"),
        (F.col("model") + logs - F.col("n_rest") * float(np.log10(facts["tail_mass"]))).alias("score"),
    )

"""Gated recurrent language model over words, with a class-factored output.

Tokens are the words of a text in lower case (A-Z only) and one end. The model knows the VOCAB most
frequent tokens, in classes of CLASS_SIZE by rank; every other token belongs to one of KINDS kinds
that its spelling decides (how it ends, and whether it has a letter beyond ASCII). It predicts a
class or kind from its state, then the token within the class by a second softmax, or within the
kind by the smoothed corpus frequencies. The probabilities of all tokens and one unseen token of
each kind add up to one.

1. Counts cover every training text: tasks count their own words, and the sums are merged by word.
2. Texts become arrays of model ids, staged once. The HEAD most frequent words (a fixed number) are
   sent to the tasks with their counts; the few words beyond are joined with the counts by word.
3. A first model is trained in one task on a bounded sample (WARM_TOKENS); from it, each task then
   trains on all its training texts by backpropagation truncated to windows of STEPS tokens, and the
   tasks' parameters are averaged, weighted by tokens.
4. Whole texts are scored in lanes: a lane reads one document after the other, and the state goes
   on from window to window and is reset between documents.

Defined results: a null or empty text is the end alone; a null id counts as a training row or not by
the crc32 of empty text; repeated rows are counted and scored each; an empty table gives no rows; if
no row is for training, every word is unseen. The result has only the columns named.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.common import stage, words_of

END = b"\n"  # no word holds white space
SMOOTH = 0.1
VOCAB, CLASS_SIZE = 2048, 64
CLASSES = VOCAB // CLASS_SIZE
HIDDEN = 16
HEAD = 1 << 18
STEPS = 32
LANES = 512
TOKENS_AT_ONCE = 1 << 22  # a task's tokens that are laid out in lanes together
WARM_TOKENS, WARM_LANES, WARM_EPOCHS = 250_000, 32, 2
WORDS_AT_ONCE = 600_000  # distinct words that a task counts before it passes its sums on
BLOCKS = 16  # pieces of the parameters that are averaged apart
ENDINGS = [b".", b",", b"!", b"#*$%&|<>", b"0123456789", b"abcdefghijklmnopqrstuvwxyz"]
KINDS = 2 * (len(ENDINGS) + 2)
ENDING_OF = np.full(256, len(ENDINGS), np.int64)  # any other ASCII byte
for _i, _bytes in enumerate(ENDINGS):
    ENDING_OF[list(_bytes)] = _i
ENDING_OF[128:] = len(ENDINGS) + 1


def kind_of(word: bytes) -> int:
    return 2 * int(ENDING_OF[word[-1]]) + (not word.isascii())


@dataclass
class Corpus:
    """Bounded facts of the training counts, sent to tasks."""

    words: list[bytes]  # the most frequent tokens, HEAD at most
    counts: np.ndarray  # their counts
    total: int  # tokens
    distinct: int
    kind_mass: np.ndarray  # smoothed counts of the tokens outside the vocabulary, by kind

    def ids(self) -> np.ndarray:
        """Model id of each head token: its rank, or VOCAB + kind."""
        out = np.arange(len(self.words))
        out[VOCAB:] = [VOCAB + kind_of(w) for w in self.words[VOCAB:]]
        return out


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n, kind) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            words = list(seen)
            return pa.record_batch(
                [pa.array(words, pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array(list(map(kind_of, words)), pa.int32())],
                names=["word", "n", "kind"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                seen[END] += 1
                if len(seen) > WORDS_AT_ONCE:
                    yield rows()
                    seen.clear()
        yield rows()

    return texts.mapInArrow(run, "word binary, n long, kind int").groupBy("word").agg(F.sum("n").alias("n"), F.min("kind").alias("kind"))


def corpus_of(counts: DataFrame) -> Corpus:
    # The head is what lies above a step of counts, eight steps to a doubling: all of a step or none.
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r.step, r.v) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect()), reverse=True)
    held, least = 0, None
    for at, v in sizes:
        if held + v > HEAD:
            break
        held, least = held + v, at
    head = counts.where(step >= F.lit(least)).select("word", "n", "kind").toArrow().to_pydict()
    order = sorted(range(len(head["word"])), key=lambda i: (-head["n"][i], head["word"][i]))
    head = {name: [column[i] for i in order] for name, column in head.items()}
    words, n = head["word"], np.array(head["n"], np.int64)
    mass = np.zeros(KINDS)
    distinct = total = 0
    for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[r.kind] += r.n + SMOOTH * r.v
        distinct, total = distinct + r.v, total + r.n
    for k, c in zip(head["kind"][:VOCAB], n[:VOCAB].tolist()):
        mass[k] -= c + SMOOTH
    return Corpus(words, n, total, distinct, np.maximum(mass, 0))


def tokenized(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """(doc_id, held_out, n_tokens, ids, head_known, head_base, head_score, tail) of every document.

    head_base sums log10(c + 0.1) of head tokens; head_score sums what the score has besides the
    model's own part, without log10(c + 0.1) of tail words, which are listed in ``tail``.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(corpus)  # HEAD words at most
    kind = docs.schema["doc_id"].dataType.simpleString()
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            c = sent.value
            state["place"] = dict(zip(c.words, range(len(c.words))))
            state["ids"] = c.ids()
            state["base"] = np.log10(c.counts + SMOOTH)
            state["mass"] = np.log10(c.kind_mass + SMOOTH)
            state["score"] = np.where(state["ids"] < VOCAB, 0.0, state["base"] - state["mass"][np.maximum(state["ids"] - VOCAB, 0)])
        place, ids_of, base_of, score_of, mass = (state[k] for k in ("place", "ids", "base", "score", "mass"))
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                words.append(END)
                at = np.array([place.get(w, -1) for w in words])
                out = np.flatnonzero(at < 0).tolist()
                ids = ids_of[at] if len(ids_of) else np.zeros(len(at), np.int64)
                tail = [words[i] for i in out]
                kinds = [kind_of(w) for w in tail]
                ids[out] = [VOCAB + k for k in kinds]
                known = at[at >= 0]
                for column, x in zip(columns, (
                    len(words), ids.astype("<u2").tobytes(), len(known), float(base_of[known].sum()),
                    float(score_of[known].sum() - mass[kinds].sum()) if len(words) else 0.0, tail,
                )):
                    column.append(x)
            types = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, columns, types)],
                names=["doc_id", "held_out", "n_tokens", "ids", "head_known", "head_base", "head_score", "tail"])

    return docs.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, ids binary, head_known long, head_base double, head_score double, tail array<binary>")


class Gru:
    """The network, in single precision; ``parameters`` is one flat array that the named views share."""

    SHAPES = {
        "inputs": (VOCAB + KINDS, 3 * HIDDEN), "loops": (HIDDEN, 3 * HIDDEN), "bias": (3 * HIDDEN,),
        "classes": (HIDDEN, CLASSES + KINDS), "class_bias": (CLASSES + KINDS,), "words": (VOCAB, HIDDEN), "word_bias": (VOCAB,),
    }

    def __init__(self, parameters: np.ndarray):
        self.parameters = parameters
        at = 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, parameters[at : at + size].reshape(shape))
            at += size
        # A kind's number follows the classes' numbers.
        self.class_of = np.concatenate([np.arange(VOCAB) // CLASS_SIZE, CLASSES + np.arange(KINDS)])

    @classmethod
    def start(cls, corpus: Corpus) -> Gru:
        """Small random weights; biases that give the corpus frequencies."""
        size = sum(int(np.prod(s)) for s in cls.SHAPES.values())
        net = cls((np.random.default_rng(11).standard_normal(size) * 0.08).astype(np.float32))
        known = np.full(VOCAB, SMOOTH)
        known[: min(VOCAB, len(corpus.counts))] += corpus.counts[:VOCAB]
        net.bias[:] = 0
        net.word_bias[:] = np.log(known)
        net.class_bias[:] = np.log(np.concatenate([known.reshape(CLASSES, -1).sum(1), corpus.kind_mass + SMOOTH]) / (known.sum() + corpus.kind_mass.sum() + SMOOTH))
        return net

    def advance(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each step of a window, (steps, lanes, HIDDEN), and what going back needs."""
        w = HIDDEN
        states = np.empty((len(x), len(h), w), np.float32)
        trace = []
        fed = self.inputs[x] + self.bias
        for t in range(len(x)):
            h = h * keep[t]
            back = h @ self.loops
            gates = 1 / (1 + np.exp(-(fed[t, :, : 2 * w] + back[:, : 2 * w])))
            z, r = gates[:, :w], gates[:, w:]
            new = np.tanh(fed[t, :, 2 * w :] + r * back[:, 2 * w :])
            trace.append((h, z, r, new, back[:, 2 * w :]))
            h = new + z * (h - new)
            states[t] = h
        return states, trace

    def within(self, y: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Places of the vocabulary's tokens, by class."""
        own = self.class_of[y].astype(np.uint8)
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(CLASSES + 1))
        return [(c, order[ends[c] : ends[c + 1]]) for c in range(CLASSES) if ends[c] < ends[c + 1]]

    def log_probability(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the probability of class (and word within it) for states and next tokens."""
        scores = h @ self.classes + self.class_bias
        out = scores[np.arange(len(y)), self.class_of[y]] - np.log(np.exp(scores).sum(1))
        for c, at in self.within(y):
            rows = slice(c * CLASS_SIZE, (c + 1) * CLASS_SIZE)
            s = h[at] @ self.words[rows].T + self.word_bias[rows]
            top = s.max(1)
            out[at] += s[np.arange(len(at)), y[at] - rows.start] - top - np.log(np.exp(s - top[:, None]).sum(1))
        return out

    def gradient(self, x: np.ndarray, keep: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[Gru, np.ndarray, np.ndarray]:
        """Gradient of the mean log loss over a window, the state after it, and the rows of inputs it touches.

        y is negative where a lane has ended.
        """
        w, grad = HIDDEN, Gru(np.zeros_like(self.parameters))
        states, trace = self.advance(x, keep, h)
        flat, targets = states.reshape(-1, w), y.reshape(-1)
        real = np.flatnonzero(targets >= 0)
        hs, ys = flat[real], targets[real]
        scale = np.float32(1 / max(1, len(real)))
        scores = hs @ self.classes + self.class_bias
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(ys)), self.class_of[ys]] -= 1
        p *= scale
        grad.classes[:] = hs.T @ p
        grad.class_bias[:] = p.sum(0)
        dh = p @ self.classes.T
        for c, at in self.within(ys):
            rows = slice(c * CLASS_SIZE, (c + 1) * CLASS_SIZE)
            own = hs[at]
            s = own @ self.words[rows].T + self.word_bias[rows]
            q = np.exp(s - s.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(at)), ys[at] - rows.start] -= 1
            q *= scale
            grad.words[rows] = q.T @ own
            grad.word_bias[rows] = q.sum(0)
            dh[at] += q @ self.words[rows]
        spread = np.zeros_like(flat)
        spread[real] = dh
        spread = spread.reshape(states.shape)
        fed = np.empty((*x.shape, 3 * w), np.float32)
        carried = np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, new, back = trace[t]
            d = spread[t] + carried
            dn = d * (1 - z) * (1 - new * new)
            dr = dn * back * r * (1 - r)
            dz = d * (before - new) * z * (1 - z)
            fed[t, :, :w], fed[t, :, w : 2 * w], fed[t, :, 2 * w :] = dz, dr, dn
            loop = np.concatenate([dz, dr, dn * r], 1)
            grad.loops += before.T @ loop
            carried = (d * z + loop @ self.loops.T) * keep[t]
        grad.bias[:] = fed.sum((0, 1))
        ids = x.reshape(-1)
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        grad.inputs[ids[first]] = np.add.reduceat(fed.reshape(-1, 3 * w)[order], first, axis=0)
        return grad, states[-1], ids[first]


def in_lanes(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents dealt to lanes of about equal length, longest lane first: ids and document numbers, (steps, lanes).

    Places after a lane's end hold -1.
    """
    sizes = [len(d) for d in docs]
    lanes = max(1, min(most, len(docs), sum(sizes) // max(sizes)))
    heap = [(0, i) for i in range(lanes)]
    held: list[list[int]] = [[] for _ in range(lanes)]
    loads = [0] * lanes
    for i in sorted(range(len(docs)), key=lambda i: -sizes[i]):
        load, lane = heapq.heappop(heap)
        held[lane].append(i)
        loads[lane] = load + sizes[i]
        heapq.heappush(heap, (loads[lane], lane))
    ids = np.full((lanes, max(loads)), -1, np.int32)
    whose = np.zeros((lanes, max(loads)), np.int32)
    for row, lane in enumerate(sorted(range(lanes), key=lambda k: -loads[k])):
        ids[row, : loads[lane]] = np.concatenate([docs[i] for i in held[lane]])
        whose[row, : loads[lane]] = np.repeat(held[lane], [sizes[i] for i in held[lane]])
    return np.ascontiguousarray(ids.T), np.ascontiguousarray(whose.T)


def windows(ids: np.ndarray, end: int, steps: int) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of the lanes that still run: rows, number of lanes, inputs, whether the state goes on, targets."""
    lengths = (ids >= 0).sum(0)
    before = np.vstack([np.full((1, ids.shape[1]), end, ids.dtype), ids[:-1]])
    before[before < 0] = end
    for start in range(0, len(ids), steps):
        n = int((lengths > start).sum())
        rows = slice(start, start + steps)
        x = before[rows, :n]
        yield rows, n, x, (x != end)[:, :, None].astype(np.float32), ids[rows, :n]


def train(net: Gru, docs: list[np.ndarray], end: int, lanes: int, past: np.ndarray, rate: float = 0.08) -> int:
    """One pass of truncated backpropagation with per-parameter rates; ``past`` sums squared gradients."""
    ids, _ = in_lanes(docs, lanes)
    h, tokens = np.zeros((ids.shape[1], HIDDEN), np.float32), 0
    rows_of_inputs = net.inputs.size
    seen = past[:rows_of_inputs].reshape(net.inputs.shape)
    for _, n, x, keep, y in windows(ids, end, STEPS):
        grad, last, touched = net.gradient(x, keep, y, h[:n])
        h = last
        tokens += int((y >= 0).sum())
        g = np.clip(grad.inputs[touched], -0.05, 0.05)
        seen[touched] += g * g
        net.inputs[touched] -= rate * g / (np.sqrt(seen[touched]) + 1e-6)
        g = np.clip(grad.parameters[rows_of_inputs:], -0.05, 0.05)
        past[rows_of_inputs:] += g * g
        net.parameters[rows_of_inputs:] -= rate * g / (np.sqrt(past[rows_of_inputs:]) + 1e-6)
    return tokens


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """The ids of documents, in lists of about ``most`` tokens."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column("ids").to_pylist():
            held.append(np.frombuffer(raw, "<u2").astype(np.int32))
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def warmed(texts: DataFrame, corpus: Corpus, end: int) -> np.ndarray:
    """Parameters and squared gradients after training on a bounded sample, in one task."""
    share = min(1.0, WARM_TOKENS / max(1, corpus.total))
    sample = texts.where(F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Gru.start(corpus)
        past = np.full_like(net.parameters, 1e-8)
        for docs in gathered(batches, 2 * WARM_TOKENS):
            for _ in range(WARM_EPOCHS):
                train(net, docs, end, WARM_LANES, past)
        yield pa.record_batch([pa.array([net.parameters.tobytes()], pa.binary()), pa.array([past.tobytes()], pa.binary())], names=["p", "g"])

    rows = sample.repartition(1).mapInArrow(run, "p binary, g binary").collect()
    if not rows:
        net = Gru.start(corpus)
        return np.stack([net.parameters, np.full_like(net.parameters, 1e-8)])
    return np.stack([np.frombuffer(bytes(rows[0].p), np.float32), np.frombuffer(bytes(rows[0].g), np.float32)])


def averaged(texts: DataFrame, start: np.ndarray, end: int) -> np.ndarray:
    """Parameters after every task has trained on all its texts, averaged by tokens."""
    sent = texts.sparkSession.sparkContext.broadcast(start)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, past, tokens = Gru(sent.value[0].copy()), sent.value[1].copy(), 0
        for docs in gathered(batches, TOKENS_AT_ONCE):
            tokens += train(net, docs, end, LANES, past)
        if tokens:
            parts = np.array_split(net.parameters.astype(np.float64) * tokens, BLOCKS)
            salt = TaskContext.get().partitionId() % 64
            yield pa.record_batch([
                pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array([float(tokens)] * BLOCKS, pa.float64()),
                pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["block", "salt", "tokens", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, tokens, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                held = sums.setdefault(block, [0.0, 0.0])
                held[0] += tokens
                held[1] = held[1] + np.frombuffer(part, np.float32)
        if sums:
            yield pa.record_batch([
                pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([h[0] for h in sums.values()], pa.float64()),
                pa.array([np.asarray(h[1], np.float32).tobytes() for h in sums.values()], pa.binary())], names=["block", "salt", "tokens", "sums"])

    schema = "block int, salt int, tokens double, sums binary"
    own = texts.select("ids").mapInArrow(run, schema)
    merged = own.repartition("block", "salt").mapInArrow(merge, schema).repartition("block").mapInArrow(merge, schema)
    rows = sorted((r.block, r.tokens, bytes(r.sums)) for r in merged.collect())
    if not rows:
        return start[0]
    return np.concatenate([np.frombuffer(raw, np.float32) / tokens for _, tokens, raw in rows]).astype(np.float32)


def model_scores(texts: DataFrame, parameters: np.ndarray, end: int) -> DataFrame:
    """Adds ``model_score``: the log10 probability of classes, kinds and vocabulary words of each whole text."""
    sent = texts.sparkSession.sparkContext.broadcast(parameters)
    kept = texts.drop("ids")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Gru(sent.value)
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            docs = [np.frombuffer(raw, "<u2").astype(np.int32) for raw in table.column("ids").to_pylist()]
            ids, whose = in_lanes(docs, LANES)
            sums, h = np.zeros(len(docs)), np.zeros((ids.shape[1], HIDDEN), np.float32)
            for rows, n, x, keep, y in windows(ids, end, 2 * STEPS):
                states, _ = net.advance(x, keep, h[:n])
                h = states[-1]
                real = np.flatnonzero(y.reshape(-1) >= 0)
                found = net.log_probability(states.reshape(-1, HIDDEN)[real], y.reshape(-1)[real])
                sums += np.bincount(whose[rows, :n].reshape(-1)[real], found, len(docs))
            out = table.drop_columns(["ids"]).append_column("model_score", pa.array(sums / np.log(10)))
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.column("ids").nbytes // 2
            if size >= TOKENS_AT_ONCE:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, f"{fields}, model_score double")


def scores(docs: DataFrame, held_out: str = "held_out", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Rows whose ``held_out`` is false are learned from.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(held_out).alias("held_out"), F.col(text).cast("binary").alias("text"))
    counts = stage(count_words(rows.where("NOT held_out").select("text")), "counts")
    corpus = corpus_of(counts)
    texts = stage(tokenized(rows, corpus).withColumn("row", F.monotonically_increasing_id()), "tokens")
    try:
        end = int(corpus.ids()[corpus.words.index(END)])
    except ValueError:
        end = VOCAB + kind_of(END)
    learned = texts.where("NOT held_out")
    parameters = averaged(learned, warmed(learned, corpus, end), end)
    scored = stage(model_scores(texts.drop("tail"), parameters, end), "scored")

    # Words beyond the head, joined with their counts; a word the training texts don't have counts 0.
    tail = texts.where(F.size("tail") > 0).select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    found = tail.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("tail_base"))
    base = F.col("head_base") + F.coalesce("tail_base", F.lit(0.0))
    divisor = float(np.log10(corpus.total + SMOOTH * (corpus.distinct + 1)))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(corpus.total).cast("long").alias("train_tokens"), (base - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("model_score") + F.col("head_score") + F.coalesce("tail_base", F.lit(0.0))).alias("score"))

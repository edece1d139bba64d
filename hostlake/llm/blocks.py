"""HTML extraction: a recurrent block labeller says which leaf blocks of a page are its article.

Each leaf block is a hashed vector of the element path around it and one of its words, and a few measures. A
bidirectional LSTM reads all blocks of the page, in both directions, so every block is labelled with the whole page in view. It is
trained on invented pages (``templates``) whose labels are known by their making; no page of the table is used for it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm.htmlblocks import leaves
from hostlake.llm.runtime import small_batches, table
from hostlake.llm.templates import MARK, Pages

#: Sizes of the hashed vectors of paths and words, number of measures, units of each direction.
PATHS, WORDS, MEASURES, UNITS = 512, 256, 12, 24
#: Invented pages to learn from, rounds over them, seed.
PAGES, ROUNDS, SEED = 2000, 5, 11
#: Pages and blocks that are labelled at once; blocks of a very long page.
BATCH, BATCH_BLOCKS, STEPS = 256, 16_384, 4096


@lru_cache(1 << 16)
def _path_features(path: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a path: its elements, the words of their names and their beginnings, pairs of neighbours."""
    found: dict[int, float] = {}

    def add(token: str, weight: float) -> None:
        at = zlib.crc32(token.encode()) % PATHS
        found[at] = max(found.get(at, 0.0), weight)

    for depth, (tag, marks) in enumerate(reversed(path)):
        weight = 1.0 if depth < 4 else 0.7
        add(f"{tag}{min(depth, 1)}", 1.0)
        add(tag, weight)
        if depth + 1 < len(path) and depth < 4:
            add(f"{path[-depth - 2][0]}>{tag}", weight)
        for mark in marks:
            add(f".{mark}", weight)
            add(f".{mark[:4]}*", 0.7 * weight)
    return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.float32, len(found))


@lru_cache(1 << 17)
def _word_place(word: str) -> int:
    return zlib.crc32(word.encode()) % WORDS


def _word_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = Counter(map(_word_place, text.lower().split()))
    weights = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    return np.fromiter(counts, np.int64, len(counts)), weights / max(1e-6, float(np.sqrt((weights**2).sum())))


def _measures(path: tuple, text: str, links: int, at: int, total: int, same: int) -> list[float]:
    n = len(text)
    words = text.count(" ") + 1
    tag = path[-1][0] if path else ""
    return [np.log1p(n) / 5, np.log1p(words) / 4, min(1.0, links / n), text.count(",") / words, sum(map(text.count, ".!?")) / words, text[-1] in ".!?", at / max(1, total - 1), 1 / (1 + at), 1 / (total - at), len(path) / 8, tag[0:1] == "h" and tag[1:].isdigit(), np.log1p(same) / 4]


@dataclass
class Block:
    path: tuple
    text: str
    links: int


def blocks_of(page: str) -> list[Block]:
    return [Block(*leaf) for leaf in leaves(page)]


def inputs(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (blocks by pages by features) and which of them are there."""
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), PATHS + WORDS + MEASURES), np.float32)
    there = np.zeros((longest, len(pages)), np.float32)
    for b, blocks in enumerate(pages):
        there[: len(blocks), b] = 1
        same = Counter(block.path for block in blocks)
        for t, block in enumerate(blocks):
            row = x[t, b]
            where, weight = _path_features(block.path)
            row[where] = weight
            where, weight = _word_features(block.text)
            row[PATHS + where] = weight
            row[PATHS + WORDS :] = _measures(block.path, block.text, block.links, t, len(blocks), same[block.path])
    return x, there


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per block. ``p`` holds its arrays: input, recurrent weights and biases of each direction, output weights."""

    def __init__(self, parameters: dict[str, np.ndarray]) -> None:
        self.p = parameters
        self.seen: dict[tuple, np.ndarray] = {}

    @classmethod
    def fresh(cls, seed: int, units: int = UNITS) -> Labeller:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {}
        for d in "fb":
            p[f"w{d}"], p[f"u{d}"] = draw(PATHS + WORDS + MEASURES, 4 * units) * 2, draw(units, 4 * units)
            p[f"c{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), units)  # forget gates begin open
        p["v"], p["e"] = draw(2 * units, 1), np.zeros(1, np.float32)
        return cls(p)

    def _pass(self, gates: np.ndarray, there: np.ndarray, u: np.ndarray, tape: list | None = None, begin: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """States after each block in the order given, and the last one to go on from; a block that isn't there leaves the state as it is."""
        n = u.shape[0]
        h, c = begin or (np.zeros((gates.shape[1], n), np.float32), np.zeros((gates.shape[1], n), np.float32))
        out = np.empty((len(gates), *h.shape), np.float32)
        for t in range(len(gates)):
            z = gates[t] + h @ u
            act = _sigmoid(z[:, : 3 * n])
            i, f, o, g = act[:, :n], act[:, n : 2 * n], act[:, 2 * n :], np.tanh(z[:, 3 * n :])
            m = there[t][:, None]
            fresh = f * c + i * g
            tanh = np.tanh(fresh)
            if tape is not None:
                tape.append((i, f, o, g, c, tanh, h, m))
            c = m * fresh + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out, (h, c)

    def states(self, x: np.ndarray, there: np.ndarray, tapes: dict | None = None) -> np.ndarray:
        both = []
        for d, turn in (("f", slice(None)), ("b", slice(None, None, -1))):
            gates = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
            tape = None if tapes is None else tapes.setdefault(d, [])
            both.append(self._pass(gates[turn], there[turn], self.p[f"u{d}"], tape)[0][turn])
        return np.concatenate(both, 2)

    def gates(self, blocks: list[Block], at: int, total: int, same: dict) -> np.ndarray:
        """What each block puts into the gates of both directions. Equal paths are put through the weights once."""
        w = np.concatenate([self.p["wf"], self.p["wb"]], 1)
        x = np.zeros((len(blocks), WORDS + MEASURES), np.float32)
        rows = np.empty((len(blocks), w.shape[1]), np.float32)
        for i, b in enumerate(blocks):
            found = self.seen.get(b.path)
            if found is None:
                where, weight = _path_features(b.path)
                if len(self.seen) > 50_000:
                    self.seen.clear()
                found = self.seen[b.path] = weight @ w[where]
            rows[i] = found
            where, weight = _word_features(b.text)
            x[i, where] = weight
            x[i, WORDS:] = _measures(b.path, b.text, b.links, at + i, total, same[b.path])
        return rows + x @ w[PATHS:] + np.concatenate([self.p["cf"], self.p["cb"]])

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Scores of the blocks of pages, which should be of like length. Of very long ones some blocks are in hand at a time, once for each direction."""
        longest = max(map(len, pages))
        same = [Counter(b.path for b in blocks) for blocks in pages]
        n = self.p["uf"].shape[0]
        margins = np.zeros((longest, len(pages)), np.float32)
        held: dict[int, tuple] = {}

        def part(lo: int) -> tuple[np.ndarray, np.ndarray]:
            if lo not in held:
                size = min(STEPS, longest - lo)
                gates, there = np.zeros((size, len(pages), 8 * n), np.float32), np.zeros((size, len(pages)), np.float32)
                for k, blocks in enumerate(pages):
                    if some := blocks[lo : lo + size]:
                        gates[: len(some), k] = self.gates(some, lo, len(blocks), same[k])
                        there[: len(some), k] = 1
                held.clear()
                held[lo] = gates, there
            return held[lo]

        steps = range(0, longest, STEPS)
        for d, turn, order in (("f", 1, steps), ("b", -1, steps[::-1])):
            state = None
            for lo in order:
                gates, there = part(lo)
                mine = gates[:, :, : 4 * n] if d == "f" else gates[:, :, 4 * n :]
                out, state = self._pass(mine[::turn], there[::turn], self.p[f"u{d}"], None, state)
                margins[lo : lo + len(out)] += (out[::turn] @ (self.p["v"][:n] if d == "f" else self.p["v"][n:]))[..., 0]
        score = _sigmoid(margins + self.p["e"])
        return [score[: len(blocks), k] for k, blocks in enumerate(pages)]

    def gradients(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the blocks that are there, and its derivatives."""
        tapes: dict = {}
        states = self.states(x, there, tapes)
        score = _sigmoid((states @ self.p["v"])[..., 0] + self.p["e"])
        total = max(1.0, float(there.sum()))
        loss = -float((there * (y * np.log(score + 1e-7) + (1 - y) * np.log(1 - score + 1e-7))).sum()) / total
        d_out = ((score - y) * there / total)[..., None]
        grads = {"v": np.einsum("tbi,tbj->ij", states, d_out), "e": d_out.sum((0, 1))}
        d_states = d_out @ self.p["v"].T
        n = self.p["uf"].shape[0]
        flat = x.reshape(-1, x.shape[2])
        for k, (d, turn) in enumerate((("f", slice(None)), ("b", slice(None, None, -1)))):
            u = self.p[f"u{d}"]
            above = d_states[..., k * n : (k + 1) * n][turn]
            dz = np.empty((*above.shape[:2], 4 * n), np.float32)
            dh = np.zeros(above.shape[1:], np.float32)
            dc = np.zeros_like(dh)
            du = np.zeros_like(u)
            for t in range(len(above) - 1, -1, -1):
                i, f, o, g, c, tanh, h, m = tapes[d][t]
                dh = dh + above[t]
                own = dh * m
                inner = dc * m + own * o * (1 - tanh**2)
                z = dz[t]
                z[:, :n], z[:, n : 2 * n] = inner * g * i * (1 - i), inner * c * f * (1 - f)
                z[:, 2 * n : 3 * n], z[:, 3 * n :] = own * tanh * o * (1 - o), inner * i * (1 - g**2)
                du += h.T @ z
                dh = z @ u.T + dh * (1 - m)
                dc = inner * f + dc * (1 - m)
            dz = dz[turn]
            grads |= {f"w{d}": flat.T @ dz.reshape(-1, 4 * n), f"u{d}": du, f"c{d}": dz.sum((0, 1))}
        return loss, grads


def invented(seed: int, count: int) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of ``count`` invented pages."""
    pages, out = Pages(seed), []
    while len(out) < count:
        blocks = blocks_of(pages.page())
        y = np.array([MARK in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace(MARK, "")
        keep = [i for i, b in enumerate(blocks) if b.text]
        if keep:
            out.append(([blocks[i] for i in keep], y[keep]))
    return out


@lru_cache(4)
def trained(pages: int = PAGES, rounds: int = ROUNDS, seed: int = SEED) -> Labeller:
    """A labeller that has learnt from ``pages`` invented pages (Adam, pages of like length together). The same arguments give the same one."""
    examples = sorted(invented(seed, pages), key=lambda e: len(e[0]))
    batches = []
    for i in range(0, len(examples), 32):
        x, there = inputs([blocks for blocks, _ in examples[i : i + 32]])
        y = np.zeros_like(there)
        for k, (_, labels) in enumerate(examples[i : i + 32]):
            y[: len(labels), k] = labels
        batches.append((x.astype(np.float16), there, y))
    model, rng = Labeller.fresh(seed), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for turn in range(rounds):
        rate = 0.01 * (0.5**turn)
        for b in rng.permutation(len(batches)):
            x, there, y = batches[b]
            x = x * (rng.random(x.shape, np.float32) > 0.1)  # some features go unseen, so that none is leant on alone
            _, grads = model.gradients(x, there, y)
            step += 1
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def labelled(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Scores of the blocks of each page; pages of like length go together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < BATCH and (stop + 1 - at) * len(pages[order[stop]]) <= BATCH_BLOCKS:
            stop += 1
        for i, scores in zip(order[at:stop], model.scores([pages[i] for i in order[at:stop]]), strict=True):
            out[i] = scores
        at = stop
    return out


def extracted(pages: DataFrame, model: Labeller | None = None, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep``, ``text`` (article blocks in page order, joined by an empty line), ``n_chars`` (its code points), ``n_blocks`` (of the page).

    A null, empty or textless page has an empty text. Pages are read whole; ids may be null or repeat, and equal pages have equal
    texts whatever lies beside them. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    small_batches(pages.sparkSession, 500)
    weights = (model or trained()).p

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Labeller(weights)
        for batch in batches:
            source = batch.column(len(keep))
            lo = 0
            while lo < batch.num_rows:
                hi, size = lo, 0
                parts: list[list[Block]] = []
                while hi < batch.num_rows and (hi == lo or size < 4 << 20):
                    page = source[hi].as_py() or ""
                    parts.append(blocks_of(page))
                    size += len(page)
                    hi += 1
                texts = ["\n\n".join(b.text for b, s in zip(blocks, score, strict=True) if s >= 0.5) for blocks, score in zip(parts, labelled(mine, parts), strict=True)]
                counts = [[len(t) for t in texts], [len(p) for p in parts]]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[: len(keep)]), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=[*keep, "text", "n_chars", "n_blocks"])
                lo = hi

    one = pages.select(*keep, F.col(html).cast("string").alias("__html"))
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())])
    return one.mapInArrow(each, schema)


def op13_blocks(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op13_blocks": op13_blocks}

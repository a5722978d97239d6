"""Sampled subword segmentation over the piece lattice, and its lossless decoding.

A text becomes words that each begin with their white-space marks; no piece of the
vocabulary holds a mark after another character, so the lattice of the text is the chain of
its words' lattices. Forward filtering sums, for each place in a word, the probability of
all segmentations up to it; backward sampling then draws pieces from the end. The draws
come from a counter keyed by the row key, the word's number and the step, so a row's
segmentation is the same on any cluster and in any order.

Characters that no piece covers fall back to their UTF-8 bytes, and so does a white-space
mark that stands in the text itself; decoding gives back every text exactly.

Lattices of all new words of a batch are built together with numpy; those of known words
are kept. Every step of backward sampling is one binary search for all words of a batch. A word of over
``LONG`` letters is sampled by itself, alike, in time and memory that grow with its length.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import fresh, trimmed
from lodestone.llm._words import mix

MARK = "▁"
#: Stands for a mark that is part of the text: a surrogate, so no text holds it.
LITERAL = "\ud800"
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_SPREAD = U(0xD6E8FEB86659FD93)
_RUNS = re.compile(" *[^ ]+| +").findall


#: Letters from which a word is sampled by itself, without a lattice that is kept.
LONG = 512


class Words(dict):
    """Numbers of words; words met first are queued, long ones (number -1) set aside."""

    def __init__(self):
        self.new: list[str] = []
        self.long: list[str] = []

    def __missing__(self, word):
        if len(word) > LONG:
            self.long.append(word)
            return -1
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _codes(words: list[str], width: int) -> np.ndarray:
    # UTF-32 keeps surrogates with "surrogatepass"; each word is padded to the same width.
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


class Lattice:
    """Pieces of a SentencePiece file with probabilities by rank, ``1 / (rank + shift) ** power``."""

    def __init__(self, path: str, power: float = 1.0, shift: float = 8.0, most_edges: int = 6_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, self.byte, self.spell = [], {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.spell[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append((piece, i, -model.get_score(i)))
                self.spell[i] = piece.replace(MARK, " ").encode()
        self.longest = max(len(p) for p, _, _ in plain)
        self.texts, self._known = [p for p, _, _ in plain], {}
        weight = np.array([-power * np.log(s + shift) for _, _, s in plain])
        top = weight.max()
        weight -= top + np.log(np.exp(weight - top).sum())
        # A byte is as likely as a piece a hundred times rarer than the rarest.
        self.byte_weight = float(weight.min() - np.log(100))
        # Where no piece holds a line break, the lattice of a text falls apart there too.
        self.line_breaks = not any("\n" in p for p, _, _ in plain)
        hashes = np.array([self._hash(p) for p, _, _ in plain], U)
        order = np.argsort(hashes)
        self.hash, self.weight, self.id = hashes[order], weight[order], np.array([i for _, i, _ in plain], np.int64)[order]
        self.most_edges = most_edges
        self.scale = [U(pow(int(_BASE), k, 1 << 64)) for k in range(self.longest + 1)]
        # Pieces by 20 bits of their hash; of those that share a place, the others by 20 more.
        with np.errstate(over="ignore"):
            spread = self.hash * _SPREAD
        place, spare = (spread >> U(44)).astype(np.int64), (spread >> U(20)).astype(np.int64) & 0xFFFFF
        self.first, self.second = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int32)
        self.first[place] = np.arange(len(place))
        hidden = np.flatnonzero(self.first[place] != np.arange(len(place)))
        self.second[spare[hidden]] = hidden
        self.crowded = np.zeros(1 << 20, bool)
        self.crowded[place[hidden]] = True
        if (self.second[spare[hidden]] != hidden).any():
            raise ValueError("two pieces share both places")
        self.clear()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def clear(self) -> None:
        self.words = Words()
        self.end = np.zeros(0, np.int64)  # of each word: its last node
        self.cum, self.prev, self.edge = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.nodes = 0

    def grow(self) -> None:
        """Lattices of the queued words, all words of one length together."""
        new, self.words.new = self.words.new, []
        if not new:
            return
        ends = np.zeros(len(new), np.int64)
        cums, prevs, edges = [self.cum], [self.prev], [self.edge]
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(new):
            groups.setdefault(len(w), []).append(k)
        for width, members in groups.items():
            step = max(1, 200_000 // width)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                cum, prev, edge, end = self._build([new[k] for k in some], width)
                ends[some] = end
                cums.append(cum), prevs.append(prev), edges.append(edge)
        self.cum, self.prev, self.edge = np.concatenate(cums), np.concatenate(prevs), np.concatenate(edges)
        self.end = np.concatenate([self.end, ends])

    def _build(self, words: list[str], width: int):
        """Edges of the words' nodes in order, with running sums of their probabilities.

        Node (w, j) is the place after j characters of word w. Forward sums are logarithms,
        each added up relative to the place before, so no length underflows."""
        n, most = len(words), min(self.longest, width)
        code = _codes(words, width)
        fall = self._byte_weights(code)
        total = np.zeros((width + 1, n), U)
        log = np.full((width + 1, n), -np.inf)
        log[0] = 0
        node, size, weight, piece = [], [], [], []
        with np.errstate(over="ignore"):
            for j in range(width):
                total[j + 1] = total[j] * _BASE + code[:, j].astype(U) + U(1)
            for j in range(1, width + 1):
                of, k_of, w_of, id_of = [], [], [], []
                for k in range(1, min(most, j) + 1):
                    h = total[j] - total[j - k] * self.scale[k]
                    spread = h * _SPREAD
                    place = (spread >> U(44)).astype(np.int64)
                    at = self.first[place]
                    hit = self.hash[at] == h
                    other = np.flatnonzero(self.crowded[place] & ~hit)
                    if len(other):
                        at[other] = self.second[(spread[other] >> U(20)).astype(np.int64) & 0xFFFFF]
                        hit[other] = self.hash[at[other]] == h[other]
                    found = np.flatnonzero(hit)
                    at = at[found]
                    of.append(found), w_of.append(self.weight[at]), id_of.append(self.id[at])
                    k_of.append(np.full(len(found), k))
                    if k == 1 and len(found) < n:
                        bare = np.ones(n, bool)
                        bare[found] = False
                        bare = np.flatnonzero(bare)
                        of.append(bare), w_of.append(fall[bare, j - 1]), id_of.append(-1 - code[bare, j - 1].astype(np.int64))
                        k_of.append(np.ones(len(bare), np.int64))
                of, k_of, w_of = np.concatenate(of), np.concatenate(k_of), np.concatenate(w_of)
                w_of = w_of + log[j - k_of, of]
                log[j] = log[j - 1] + np.log(np.bincount(of, np.exp(w_of - log[j - 1, of]), n))
                node.append(of * width + (j - 1)), size.append(k_of), piece.append(np.concatenate(id_of))
                weight.append(np.exp(w_of - log[j, of]))
        node, size, weight, piece = (np.concatenate(x) for x in (node, size, weight, piece))
        order = np.argsort(node, kind="stable")
        node, size, weight, piece = node[order], size[order], weight[order], piece[order]
        last = np.append(node[1:] != node[:-1], True)
        cum = np.cumsum(weight)
        starts = np.flatnonzero(np.append(True, last[:-1]))
        cum -= np.repeat(cum[starts] - weight[starts], np.diff(np.append(starts, len(cum))))
        cum = np.where(last, 1.0, np.minimum(cum, 1.0))
        prev = np.where(node % width - size >= 0, self.nodes + node - size, -1)
        end = self.nodes + np.arange(n) * width + width - 1
        cum += self.nodes + node
        self.nodes += n * width
        return cum, prev, piece.astype(np.int32), end

    def _long(self, word: str, seed: np.uint64) -> list[int]:
        """Sampled pieces of one word, as its lattice would give them.

        The sizes of the pieces that end at each place are found for all places at once; a running logarithm per place is
        all that is kept of the forward sums. Backward, only the places that are drawn look their pieces up again."""
        code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, sizes, h = len(code), np.zeros(len(code), np.uint32), np.zeros(len(code), U)
        with np.errstate(over="ignore"):
            for k in range(1, min(self.longest, n) + 1):
                h = np.concatenate([h[:1], h[:-1]]) * _BASE + code.astype(U) + U(1) if k > 1 else code.astype(U) + U(1)
                sizes[k - 1 :][np.isin(h[k - 1 :], self.hash)] |= np.uint32(1 << (k - 1))
        fall = self._byte_weights(code).tolist()
        known, ends = self.known(), sizes.tolist()
        steps: dict[int, list[int]] = {}
        log = array("d", [0.0]) * (n + 1)
        for j in range(1, n + 1):
            mask, before = ends[j - 1], log[j - 1]
            total = 0.0 if mask & 1 else math.exp(fall[j - 1])
            if mask:
                if mask not in steps:
                    steps[mask] = [k for k in range(1, self.longest + 1) if mask >> (k - 1) & 1]
                for k in steps[mask]:
                    total += math.exp(known[word[j - k : j]][1] + log[j - k] - before)
            log[j] = before + math.log(total)
        out, j, step, draws = [], n, 0, []
        while j:
            if step % 4096 == 0:
                with np.errstate(over="ignore"):
                    draws = ((mix(seed + (np.arange(4096, dtype=U) + U(step)) * U(0x9E3779B97F4A7C15)) >> U(40)).astype(float) * 2.0**-24).tolist()
            u, mask = draws[step % 4096], ends[j - 1]
            options = [(1, -1 - int(code[j - 1]), fall[j - 1])] if not mask & 1 else []
            options += [(k, *known[word[j - k : j]]) for k in steps.get(mask, ())]
            summed, chosen = 0.0, options[-1]
            for option in options:
                summed += math.exp(option[2] + log[j - option[0]] - log[j])
                if summed > u:
                    chosen = option
                    break
            out.append(chosen[1])
            j -= chosen[0]
            step += 1
        return out[::-1]

    def known(self) -> dict[str, tuple[int, float]]:
        """Identifier and weight of each piece, by its text."""
        if not self._known:
            by_hash = {int(h): (int(i), float(w)) for h, i, w in zip(self.hash, self.id, self.weight, strict=True)}
            self._known.update({p: by_hash[self._hash(p)] for p in self.texts})
        return self._known

    def _byte_weights(self, code: np.ndarray) -> np.ndarray:
        n = 1 + (code >= 0x80).astype(int) + (code >= 0x800) + (code >= 0x10000)
        return n * self.byte_weight

    def encode(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece identifiers of a sampled segmentation of each text."""
        if len(self.cum) > self.most_edges:
            self.clear()
        parts = []
        for t in texts:
            lines = t.replace(MARK, LITERAL).split("\n") if self.line_breaks else [t.replace(MARK, LITERAL)]
            part: list[str] = []
            for k, line in enumerate(lines):
                if k:
                    part.append("\n")
                elif t:
                    line = f" {line}"
                if "  " in line or line.endswith(" "):
                    part += [w.replace(" ", MARK) for w in _RUNS(line)]
                elif line:
                    part += line.replace(" ", f" {MARK}").split(" ") if line[0] != " " else (MARK + line[1:].replace(" ", f" {MARK}")).split(" ")
            parts.append(part)
        count = np.array([len(p) for p in parts], np.int64)
        number = np.fromiter((self.words[w] for p in parts for w in p), np.int64, int(count.sum()))
        self.grow()
        long, self.words.long = self.words.long, []
        if not len(number):
            return [np.zeros(0, np.int64) for _ in texts]
        doc = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(number)) - (np.cumsum(count) - count)[doc]
        with np.errstate(over="ignore"):
            seed = mix(seeds.astype(U)[doc] ^ mix(nth.astype(U) + U(0x632BE59BD9B4E019)))
        alone = np.flatnonzero(number < 0) if long else np.zeros(0, np.int64)
        sampled = [self._long(w, seed[i]) for w, i in zip(long, alone, strict=True)]
        alive = np.argsort(number)[len(alone) :]  # in the order of the lattices, so that searches stay in the cache
        node = self.end[number[alive]]
        drawn, step = [], 0
        while len(alive):
            with np.errstate(over="ignore"):
                u = (mix(seed[alive] + U(step) * U(0x9E3779B97F4A7C15)) >> U(40)).astype(float) * 2.0**-24
            e = np.searchsorted(self.cum, node + u, side="right")
            drawn.append((alive, self.edge[e]))
            to = self.prev[e]
            alive, node = alive[to >= 0], to[to >= 0]
            step += 1
        length = np.zeros(len(number), np.int64)
        for at, _ in drawn:
            length[at] += 1
        length[alone] = [len(s) for s in sampled]
        stop = np.cumsum(length)
        out = np.empty(int(stop[-1]), np.int64)
        for k, (at, ids) in enumerate(drawn):
            out[stop[at] - 1 - k] = ids
        for i, s in zip(alone, sampled, strict=True):
            out[stop[i] - len(s) : stop[i]] = s
        of = np.repeat(doc, length)
        if (out < 0).any():
            out, of = self._bytes(out, of)
        return np.split(out, np.searchsorted(of, np.arange(1, len(texts))))

    def _bytes(self, out: np.ndarray, of: np.ndarray):
        times = np.ones(len(out), np.int64)
        bare = np.flatnonzero(out < 0)
        spelled = [[self.byte[b] for b in (MARK if c == 0xD800 else chr(c)).encode()] for c in (-1 - out[bare]).tolist()]
        times[bare] = [len(s) for s in spelled]
        more, start = np.repeat(out, times), np.cumsum(times) - times
        for at, s in zip(start[bare], spelled, strict=True):
            more[at : at + len(s)] = s
        return more, np.repeat(of, times)

    def decode(self, ids) -> str:
        return b"".join(map(self.spell.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))[1:].decode()


_lattices: dict[tuple, Lattice] = {}


def lattice(path: str, power: float) -> Lattice:
    if (path, power) not in _lattices:
        _lattices[path, power] = Lattice(path, power)
    return _lattices[path, power]


def sample_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", seed: int = 0, power: float = 1.0, with_ids: bool = False) -> DataFrame:
    """All rows of ``docs`` plus ``n_pieces``, ``ids_crc32`` (little-endian unsigned 32-bit), ``lossless`` (whether decoding gave the text back) and, on demand, ``ids``.

    A null or empty text has no pieces. Rows with equal key and text get equal pieces; a
    null key draws from a seed of its own. Columns with these names are replaced; an empty
    table stays empty. ``model`` is the path of a SentencePiece file on every executor."""
    names = ["n_pieces", "ids_crc32", "lossless", *(["ids"] if with_ids else [])]
    docs = docs.drop(*names)
    own, draw = fresh(docs, "__text"), fresh(docs, "__seed")

    def run(batches):
        with_model = lattice(model, power)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                at, seed_at = part.schema.get_field_index(own), part.schema.get_field_index(draw)
                texts = [t or "" for t in part.column(at).to_pylist()]
                ids = with_model.encode(texts, part.column(seed_at).to_numpy().view(U))
                made = [pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array([with_model.decode(i) == t for i, t in zip(ids, texts, strict=True)])]
                if with_ids:
                    made.append(pa.array(ids, pa.list_(pa.int64())))
                kept = [i for i in range(part.num_columns) if i not in (at, seed_at)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *made], names=[*(part.schema.names[i] for i in kept), *names])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    seeded = docs.withColumn(own, F.col(text)).withColumn(draw, F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    return seeded.mapInArrow(trimmed(run), fields + "n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<bigint>" * with_ids)

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lodestone.llm.packing import Encoder, configurations, pack, plan  # noqa: E402
from lodestone.llm.piece_sampling import Lattice, sample_pieces  # noqa: E402
from lodestone.llm.token_counts import Merges, token_counts  # noqa: E402

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "é", "漢", "🙂", "1", "²", "!", "<|endoftext|>", "<|end", "\x1c", "\x85", "\xa0", "\x00", "Z", "▁", "q" * 40, "x" * 150]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 15))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(BPE)


def test_counts_and_ids_equal_the_library(reference):
    merges, encoder = Merges(BPE), Encoder(BPE)
    for t in texts(3000, 1):
        ids = reference.encode(t, add_special_tokens=False).ids
        assert merges.text(t) == len(ids)
        assert np.frombuffer(encoder.text(t), "<u4").tolist() == ids


def test_token_counts_of_odd_rows(odd, odd_rows, empty, reference):
    got = sorted(repr((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])) for r in token_counts(odd, BPE).collect())
    want = []
    for i, t in odd_rows:
        n = len(reference.encode(t or "", add_special_tokens=False).ids)
        want.append(repr((i, len((t or "").encode()), n, n > 512)))
    assert got == sorted(want) and token_counts(empty, BPE).count() == 0


def test_plans_place_every_piece_once():
    rng = random.Random(3)
    for _ in range(150):
        sizes = {rng.randint(1, 50): rng.randint(0, 12) for _ in range(rng.randint(0, 14))}
        intervals, bins = plan(sizes, 50, groups=rng.randint(1, 8))
        seen, full = Counter(), {}
        for length, lo, n, first, offset in intervals:
            assert lo == seen[length]
            seen[length] += n
            for i in range(n):
                full.setdefault(first + i, []).append((offset, length))
        assert seen == Counter({k: v for k, v in sizes.items() if v}) and len(full) == bins
        for slots in full.values():
            slots.sort()
            assert slots[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(slots, slots[1:], strict=False)) and sum(slots[-1]) <= 50


def test_configurations_reach_the_bound():
    # Halves and thirds fill sequences exactly.
    found = configurations([50, 33], [10, 30], 100)
    assert sum(x for _, x in found) == pytest.approx(15.0)


def test_packing_is_near_the_bound():
    rng = random.Random(9)
    sizes = Counter(min(1024, int(rng.lognormvariate(5.8, 0.9)) + 1) for _ in range(20000))
    _, bins = plan(sizes, 1024)
    assert bins <= 1.02 * sum(k * v for k, v in sizes.items()) / 1024 + 1


def test_pack_gives_every_token_once(odd, odd_rows, empty, reference):
    got = pack(odd, BPE, capacity=64, with_ids=True).collect()
    parts = {}
    for r in got:
        assert len(r["ids"]) == r["length"] <= 64 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        parts.setdefault(repr(r["doc_id"]), []).append((r["start"], r["piece"], r["ids"]))
    want = {}
    for i, t in odd_rows:
        want.setdefault(repr(i), []).append([*reference.encode(t or "", add_special_tokens=False).ids, 2])
    for k, docs in want.items():
        assert sorted(x for d in docs for x in d) == sorted(x for p in parts[k] for x in p[2])
        if len(docs) == 1:
            pieces = sorted(parts[k])
            assert [x for p in pieces for x in p[2]] == docs[0] and [p[1] for p in pieces] == list(range(len(pieces))) and all(len(p[2]) == 64 for p in pieces[1:])
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in places.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(slots, slots[1:], strict=False)) and sum(slots[-1]) <= 64
    assert pack(empty, BPE).count() == 0


def test_sampling_is_lossless_and_keyed():
    lattice, some = Lattice(PIECES), texts(800, 4)
    ids = lattice.encode(some, np.arange(800))
    assert all(lattice.decode(i) == t for i, t in zip(ids, some, strict=True))
    back = lattice.encode(some[::-1], np.arange(800)[::-1])
    assert all((a == b).all() for a, b in zip(ids, back[::-1], strict=True))


def test_sampling_follows_the_lattice():
    lattice = Lattice(PIECES)
    weight = {lattice.spell[i].decode(): w for i, w in zip(lattice.id.tolist(), lattice.weight.tolist(), strict=True)}

    def all_of(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                for rest, w in all_of(s[k:]):
                    yield (s[:k], *rest), w + weight[s[:k]]

    exact = {a: np.exp(w) for a, w in all_of(" inger")}
    total = sum(exact.values())
    n = 60_000
    drawn = Counter(tuple(lattice.spell[x].decode() for x in i.tolist()) for i in lattice.encode(["inger"] * n, np.arange(n)))
    assert max(abs(drawn[k] / n - v / total) for k, v in exact.items()) < 0.01


def test_sampling_of_odd_rows(odd, empty):
    got = sample_pieces(odd, PIECES, with_ids=True).collect()
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in got)
    assert {r["n_pieces"] for r in got if not r["text"]} == {0}
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["text"]), set()).add(r["ids_crc32"])
    assert all(len(v) == 1 for v in by.values()) and sample_pieces(empty, PIECES).count() == 0


def test_long_words_are_sampled_alike(monkeypatch):
    """By themselves as by their kept lattices, and in time that grows with their length."""
    import lodestone.llm.piece_sampling as sampling

    rng = random.Random(3)
    said = ["".join(rng.choice("abcdeéthing漢🙂▁q") for _ in range(rng.randint(1, 90))) + " " + rng.choice(["short", "a  b", ""]) for _ in range(60)]
    seeds = np.arange(60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = [x.tolist() for x in Lattice(PIECES).encode(said, seeds)]
    monkeypatch.setattr(sampling, "LONG", 2)
    alone = [x.tolist() for x in Lattice(PIECES).encode(said, seeds)]
    assert alone == whole
    monkeypatch.setattr(sampling, "LONG", 512)
    one = Lattice(PIECES)
    text = "".join(rng.choice("abcdefghilmnorstu") for _ in range(300_000))
    began = time.time()
    ids = one.encode([text, "b " + text[:1000]], seeds[:2])
    assert time.time() - began < 30
    assert [one.decode(i) for i in ids] == [text, "b " + text[:1000]]


def test_words_in_use_stay_in_the_cache(monkeypatch):
    import lodestone.llm.token_counts as counts

    monkeypatch.setattr(counts, "ROOM", 40_000)
    made = Counter()
    kept = counts.Kept(lambda w: made.update([w]) or len(w))
    for i in range(3000):
        assert kept["often"] == 5 and kept[f"w{i}"] == len(f"w{i}")
    assert made["often"] == 1 and kept.held <= 20_000 and len(kept) + len(kept.old) < 200

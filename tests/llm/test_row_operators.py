"""URL rules, packing, vectors, chat and mixing against brute force, with odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from barflow.llm import chat, mixing, near_vectors, packing, url_filter
from barflow.llm.components import components
from barflow.llm.row_queries import RULES


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(r), r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


def test_url_rules(spark):
    hosts = ["example.com", "www.Example.com", "a.www.example.com", "notexample.com", "x.net", "net", "com", "xcom", "", "m.ads.example.org", "é.com"]
    paths = ["", "/", "/en", "/en/", "/en/1?x=/fr/", "/fr/a/b/c#f", "/es/", "/EN/", "?q", "#f", "//en/", "/en/" + "d/" * 3000]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    rows += [(-1, None), (-2, ""), (-3, "example.com/en/"), (-4, "a://b://c.com/"), (-4, "a://b://c.com/"), (None, "http://x.net/es/z")]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, url_filter.judge(df, rules).collect()), key=key) == sorted(((i, *judge(u)) for i, u in rows), key=key)
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, rules.limit(0), default="block").collect()} == {"block"}


def test_bins_against_bounds():
    r = np.random.default_rng(4)
    for n in (0, 1, 5, 300, 3000):
        x = r.integers(1, 1024, n)
        bins = packing.best_fit(x, 1024)
        used = np.bincount(bins, x) if n else np.zeros(0)
        assert (used <= 1024).all() and packing.lower_bound(x, 1024) <= len(used) <= packing.lower_bound(x, 1024) * 1.06 + 1
    assert packing.lower_bound(np.array([600, 600, 600]), 1024) == 3
    assert packing.lower_bound(np.array([400] * 5), 1024) == 3


def test_exchange_between_bins():
    """Bins trade items: never more bins, none overfull, every item kept; fewer bins where best fit wastes room."""
    r = np.random.default_rng(7)
    for low, high, n in ((1, 1024, 0), (1, 1024, 1), (1, 1024, 400), (200, 500, 3000), (330, 350, 2000), (512, 513, 50), (1, 3, 4000)):
        x = r.integers(low, high, n)
        before = packing.best_fit(x, 1024)
        after = packing.exchange(x, before, 1024)
        used = np.bincount(after, x) if n else np.zeros(0)
        assert len(after) == n and (used <= 1024).all() and (used > 0).all()
        assert packing.lower_bound(x, 1024) <= len(used) <= len(np.unique(before))
        assert (low, high) != (200, 500) or len(used) < 0.98 * len(np.unique(before))
        assert (packing.exchange(x, before, 1024) == after).all()


def test_packing(documents, tokenizer):
    from tokenizers import Tokenizer

    original = Tokenizer.from_file(tokenizer)
    r = random.Random(8)
    texts = [" ".join(r.choice(["alpha", "béta", "γ", "x1"]) for _ in range(r.choice([0, 1, 30, 200, 700, 3000]))) for _ in range(40)]
    texts += [None, "", "<|endoftext|> a <|endoftext|>", "same", "same", "  \n\n x", "it's 12,5\t"]
    df = documents([(i // 2, t, "s") for i, t in enumerate(texts)])
    got = packing.sequences(df, tokenizer, per_partition=20).collect()
    docs, bins = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        docs[p["doc_id"]].append((p["piece"], p["start"], p["length"], p["ids_crc32"]))
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    want = collections.defaultdict(list)
    for i, t in enumerate(texts):
        ids = original.encode(t or "", add_special_tokens=False).ids + [2]
        at, k, n = 0, 0, len(ids) % 1024 or 1024
        while at < len(ids):
            want[i // 2].append((k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at, k, n = at + n, k + 1, 1024
    assert {d: sorted(p) for d, p in docs.items()} == {d: sorted(p) for d, p in want.items()}
    assert len(bins) <= sum(len(p) for p in docs.values()) and all(isinstance(b, int) and b >= 0 for b in bins)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.sequences(documents([]), tokenizer).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, entity long, region long")


def test_near_vectors_equal_brute_force(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(60, 16))
    x = np.concatenate([base, base[:20].repeat(6, 0) + r.normal(size=(120, 16)) * 0.04, base[:1].repeat(30, 0) + r.normal(size=(30, 16)) * 0.02, base[:5]]).astype(np.float32)
    labels = r.integers(0, 2, len(x)).tolist()
    rows = [(i, v.tolist(), y, 0, 0) for i, (v, y) in enumerate(zip(x, labels))]
    odd = [(1000, None, 0, 0, 0), (1001, [0.0] * 16, 0, 0, 0), (1002, [float("nan")] * 16, 0, 0, 0), (1003, x[0].tolist(), None, 0, 0), (1004, [None] * 16, 1, 0, 0), (1005, [1.0, 2.0], 0, 0, 0), (1006, [], 0, 0, 0), (1007, [float("inf")] * 16, 1, 0, 0), (None, x[0].tolist(), labels[0], 0, 0)]
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)) & ~np.eye(len(x), dtype=bool)
    low = np.arange(len(x))
    while True:
        new = np.array([min(low[i], low[link[i]].min(initial=i)) for i in range(len(x))])
        if (new == low).all():
            break
        low = new
    for settings in (near_vectors.Settings(), near_vectors.Settings(region=40, shard=12)):  # the small one makes regions and blocks
        got = {g["vec_id"]: g for g in near_vectors.near_vectors(vectors(spark, rows + odd), settings).collect()}
        assert len(got) == len(rows) + len(odd)
        found = sum(got[i]["n_links"] for i in range(len(x)))
        assert found >= 0.99 * link.sum() and all(got[i]["n_links"] <= link[i].sum() for i in range(len(x)))
        if found == link.sum():
            assert [got[i]["component_id"] for i in range(len(x))] == low.tolist()
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(1000, 1008))
    assert near_vectors.near_vectors(vectors(spark, [])).count() == 0
    same = near_vectors.near_vectors(vectors(spark, [(4, [1.0, 0.0], 1, 0, 0), (4, [1.0, 0.0], 1, 0, 0), (3, [2.0, 0.0], 1, 0, 0)])).collect()
    assert [(g["n_links"], g["component_id"]) for g in same] == [(2, 3)] * 3


def test_every_link_shares_a_region():
    """A ball of 20,000 and a sparse cloud: both ends of each link meet, at any number of regions; 0.4 % did not with at most 8."""
    r = np.random.default_rng(0)
    ball = r.normal(size=64) / 8 + 0.0155 * r.normal(size=(20_000, 64))
    cloud = r.normal(size=(2000, 64))
    cloud = np.concatenate([cloud, cloud + 0.12 * r.normal(size=cloud.shape)])
    for x, k in ((ball, 20), (cloud, 40)):
        x = near_vectors.unit(x).astype(np.float32)
        at = near_vectors.assign(x, near_vectors.centroids(x, k), 0.98)
        a = r.integers(0, len(x), 100_000)
        b = r.integers(0, len(x), 100_000) if k == 20 else (a + 2000) % 4000
        link = np.einsum("ij,ij->i", x[a], x[b]) >= 0.98
        assert link.sum() > 1000 and (at[a] & at[b]).any(1)[link].all()


def test_audit_counts_missed_links_over_the_whole_label(spark):
    """Two vectors link; without the link in what was found, no self-link may hide it."""
    entities = spark.createDataFrame([(0, "1", [1.0, 0.0], 1, 0), (1, "1", [1.0, 0.01], 2, 1), (2, "1", [0.0, 1.0], 1, 3), (3, "2", [1.0, 0.0], 1, 4)], "entity long, label string, embedding array<float>, weight long, vec long")
    for links, recall in (((2, 1), 1.0), ((2, 0), 2 / 3), ((0, 0), 0.0)):
        counted = spark.createDataFrame(list(enumerate(links)), "entity long, links long")
        assert near_vectors._audit(entities, counted, near_vectors.Settings()).first()[0] == recall


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    low = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    assert got == low


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "<|end|><|im_start|>", "<<SYS>> <s>", "plain \\ text", "", "<|turn|>", "ä[INST]\\"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    for control in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|end|>", "<|turn|>"):
        assert control not in chat.escape(text)


def test_chat(spark, tokenizer):
    rows = [(1, 2, "assistant", "yes </s>"), (1, 1, "user", "hi [INST]"), (1, 3, "assistant", None), (2, 1, "system", "<|endoftext|>"), (2, None, "user", "first"), (3, 1, None, "x"), (None, 1, "assistant", "lost"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {g["conv_id"]: g for g in chat.summaries(chat.format_turns(df, tokenizer), tokenizer).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["loss_chars"]) == (len(turns), len(loss))
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.summaries(chat.format_turns(df.limit(0), tokenizer), tokenizer).count() == 0


def test_mixing(spark, documents):
    r = random.Random(9)
    rows = [(i, "w " * int(r.paretovariate(1) * 10), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(500)] + [(3, "one two", "b"), (3, "one two", "b"), (600, None, "a"), (601, "", None), (602, "x", "e"), (None, "no id", "a")]
    df = documents(rows)
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert len(got) == len(rows) and all(0 <= g["taken"] <= 2 * g["size"] for g in got)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted(x for x in size if x is not None) + [None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    rest = 1.5 * sum(size.values())
    while open_:
        share = {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        full = {n for n in open_ if share[n] > 2 * size[n]}
        if not full:
            target |= share
            break
        for n in full:
            target[n] = 2.0 * size[n]
        rest -= sum(target[n] for n in full)
        open_ -= full
    taken = collections.Counter()
    for g in got:
        taken[g["source"]] += g["taken"]
        assert g["source_size"] == size[g["source"]] and abs(g["target"] - target[g["source"]]) < 1e-6
    for n in names:
        assert abs(taken[n] - target[n]) <= max(3, 0.01 * target[n]), n
    out = mixing.apply(df)
    assert out.columns == df.columns and out.count() == sum(g["copies"] for g in got)
    assert mixing.mix(documents([])).count() == 0 and mixing.apply(documents([])).count() == 0

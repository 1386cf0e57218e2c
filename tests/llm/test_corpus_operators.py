"""Operators on whole corpora: chat, decontamination, SimHash, sharding, the pipeline, and how the subpackage is set apart."""

import ast
import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from chronofold.llm import bpe, chat, decontaminate, quality, secretscan, sharding, simhash
from chronofold.llm.registry import QUERIES, SQL
from tests.test_queries import compare

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name]) > 0


# chat


def test_escapes_are_reversible():
    r = random.Random(3)
    parts = ["<", "s>", "/", "\\", "[", "INST]", "/INST]", "x", "<s>", "</s>", "[INST]", "[/INST]", "<\\s>"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)


def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for x, t, role, text in rows if x == c))
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        formatted = "<s>" + "".join(f"[INST]{chat.escape(role)}[/INST]{chat.escape(text)}</s>" for *_, role, text in turns)
        out[c] = (len(turns), sha("".join(f"{role}\n{text}\n" for *_, role, text in turns)), len(loss), sha(loss), len(formatted))
    return out


def test_conversations(spark, monkeypatch):
    rows = [(1, 1, "assistant", "a</s>[INST]"), (1, 0, "user", "q"), (1, 2, "assistant", "[/INST]"), (2, 0, None, None), (2, 0, "assistant", ""), (3, None, "odd</s>", "é\U0001f600"), (None, 0, "assistant", "x"), (None, 1, "assistant", "y"), (4, 0, "assistant", "z" * 20000), (5, 0, "user", "u"), (5, 0, "user", "u")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, part int")
    assert {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(df), in_order=True).collect()} == brute_chat(rows)
    monkeypatch.setattr(chat, "PART_IDS", 4)
    assert {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(df).repartition(5)).collect()} == brute_chat(rows)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_conversations_of_a_table(spark):
    hostile = "</s>[INST] ok [/INST]"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()] + [(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)]
    assert {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op3_chat"](spark, DATA).collect()} == brute_chat(rows)


# decontamination


def brute_hits(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    tests = {}
    for i, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            tests.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(v) for v in tests}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in tests:
                    hit |= set(range(k, k + n))
                    found |= tests[tuple(w[k : k + n])]
        found.discard(None)
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


@pytest.mark.parametrize("path", ["set", "crowded set", "no broadcast"])
def test_hits_by_brute_force(spark, monkeypatch, path):
    if path == "crowded set":
        monkeypatch.setattr(decontaminate, "SET_WORDS", 1)
    if path == "no broadcast":
        monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", -1)
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    r = random.Random(8)
    word = lambda: r.choice(["a", "B", "c1", "é", "Ä", "中", "d-e", "f"])
    docs = [(k, " ".join(word() for _ in range(r.randint(0, 60)))) for k in range(40)] + [(7, None), (8, ""), (9, "a B c1"), (9, "a B c1"), (None, "a b c1 é Ä 中 d e f a")]
    items = [(1, "a B c1"), (2, docs[3][1]), (3, None), (4, ""), (5, "zz yy"), (5, "f"), (None, docs[11][1]), (10, docs[5][1][:80])]
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, n int, h string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(x) for x in decontaminate.report(d, i).collect()), key=repr)
    assert got == sorted(brute_hits(docs, items), key=repr)
    clean = decontaminate.clean(d, i)
    assert clean.columns == d.columns and clean.count() == sum(not x[-1] for x in got)
    none = decontaminate.report(d, i.limit(0))
    assert none.count() == len(docs) and none.filter("contaminated").count() == 0 and decontaminate.report(d.limit(0), i).count() == 0


# SimHash


def slow_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(rows):
    prints = [slow_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                label[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return sorted(((d, f"{p:016x}", least.get(root(k))) for k, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)


def test_fingerprints_bit_by_bit():
    r = random.Random(1)
    for text in ["", " ", "One", "one TWO", "É é Ä", "a b c", "a b c a b c a b c", "x\ty\nz w v", *(" ".join(r.choice("abcde") for _ in range(r.randint(3, 200))) for _ in range(40))]:
        assert simhash.fingerprint(text) == slow_print(text), text


def test_components_by_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    odd = [(10_000, None), (10_001, ""), (3, rows[3][1]), (None, rows[5][1]), (None, "alone in this"), (None, None)]
    got = simhash.components(spark.createDataFrame([(*x, 1, "f") for x in rows + odd], "doc_id long, text string, component_id int, fp string"))
    assert sorted(((r["doc_id"], f"{np.int64(r['fp']).astype(np.uint64):016x}", r["component_id"]) for r in got.collect()), key=repr) == slow_components(rows + odd)
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    want = {(d, p): c for d, p, c in slow_components(rows)}
    assert {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in QUERIES["op8_simhash"](spark, DATA).collect()} == want


@pytest.mark.parametrize("chunk", [2000, 7])
def test_links_lose_nothing(spark, monkeypatch, chunk):
    """Dense balls of fingerprints, hot buckets cut into chunks: the same components as all pairs give, at most a few links a node."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(chunk)
    values = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(60):
            v = centre
            for _ in range(r.randint(0, 5)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    values |= {r.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    found = [(np.int64(x["a"]).astype(np.uint64).item(), np.int64(x["b"]).astype(np.uint64).item()) for x in simhash.links(spark.createDataFrame(signed, "fp long")).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in found)

    def groups(pairs):
        label = {v: v for v in values}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in pairs:
            label[root(a)] = root(b)
        out = {}
        for v in values:
            out.setdefault(root(v), set()).add(v)
        return sorted(map(sorted, out.values()))

    assert groups(found) == groups((a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 3)


def test_one_of_each(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text, "x"), (3, text, "y"), (3, text, "z"), (9, "something else entirely, with other words in it", "w"), (None, text, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 9]


# near copies by word shingles


def shingles(text, n=5):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]  # ASCII words only in these tests
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups_of(n, near):
    """The least member of each member's group, by all pairs."""
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(n):
        for b in range(a):
            if near(a, b):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return [root(k) for k in range(n)]


def distances(texts):
    bits = np.concatenate([simhash.Projection()(texts[k : k + 64])[0] for k in range(0, len(texts), 64)]).view(np.uint64)
    return np.array([np.bitwise_count(bits ^ b).sum(axis=1, dtype=np.int64) for b in bits])


def test_projections_by_a_plain_matrix():
    tool = simhash.Projection()
    texts = ["", "one", "a b c d", "a b c d e", "A  B\tc d e f", "x y " * 400, *(" ".join(random.Random(k).choices("abcdefgh", k=40)) for k in range(6))]
    assert [len(tool.shingles(t)) for t in texts[:6]] == [0, 1, 1, 1, 2, 2]
    assert set(tool.shingles("a b c d e f").tolist()) == set(tool.shingles(texts[4]).tolist())
    whole = np.array([[-1 if bin(i & j).count("1") & 1 else 1 for j in range(simhash.DIM)] for i in range(64)])  # the first rows of the transform
    bits, strongest = tool(texts)
    for k, text in enumerate(texts):
        x = np.zeros(simhash.DIM)
        for h in tool.shingles(text).tolist():
            x[h % simhash.DIM] += 1 - 2 * (h >> 40 & 1)
        x = tool._turn((x * tool.signs[0])[None].astype(np.float32))[0]
        assert (np.unpackbits(bits[k], bitorder="little")[:64] == (whole @ (x * tool.signs[1]) > 1e-3)).all(), text
    assert strongest.shape == (len(texts), simhash.DIM * simhash.ROTATIONS // simhash.SEGMENT) and strongest.max() < 2 * simhash.SEGMENT
    keys = simhash.chain_keys(strongest)
    n = strongest.shape[1]
    for i in (0, 1, n - 1):
        a, b, c = (int(strongest[7, (i + k) % n]) for k in range(3))
        assert keys[7, i] == ((i * 1024 + a) * 1024 + b) * 1024 + c


def test_the_pigeonring_prunes_no_alike_pair():
    r = np.random.default_rng(2)
    x = r.integers(0, 2**63, (60, 16), dtype=np.uint64)
    y = np.concatenate([x, x, x])
    for k in range(len(y)):
        for bit in r.choice(1024, int(r.integers(0, 260)), replace=False):
            y[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    for most in (0, 3, 100, 167, 1024):
        whole = np.bitwise_count(x[:, None] ^ y[None]).sum(axis=2, dtype=np.int64)
        assert (simhash.alike(x, y, most) == (whole <= most)).all()


@pytest.mark.parametrize("chunk", [2000, 9])
def test_near_copies_by_brute_force(spark, monkeypatch, chunk):
    """Families of edited texts: the groups of all pairs by fingerprint, and of planted likenesses of 0.8 or more at least 0.9 joined."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r, texts = random.Random(chunk), []
    for _ in range(40):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([6, 30, 200, 600]))]
        texts.append(" ".join(base))
        for _ in range(4):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = f"w{r.randrange(4000)}"
            texts.append("  ".join(w).upper())
    texts += ["", None, " ", "one", "two", "one", "one two three four", "one two three four five"]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, component int")
    got = {x["id"]: x["component"] for x in simhash.near_copies(df).collect()}
    label = [min(k for k in got if got[k] == got[i]) for i in range(len(texts))]
    whole = distances([t or "" for t in texts])
    want = groups_of(len(texts), lambda a, b: whole[a, b] <= simhash.most_bits())
    assert np.mean([x == y for x, y in zip(label, want)]) > 0.97  # pairs that share no chain
    assert all(want[a] == want[b] for a, b in zip(range(len(texts)), label))  # nothing is joined that is not alike
    sets = [shingles(t) for t in texts]
    planted = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(planted) > 100 and np.mean([label[a] == label[b] for a, b in planted]) > 0.9
    far = [(a, b) for a in range(200) for b in range(a) if a // 5 != b // 5]
    assert not any(label[a] == label[b] for a, b in far)
    assert label[-8] == label[-7] == label[-6] and label[-5] == label[-3] != label[-4] and simhash.near_copies(df.limit(0)).count() == 0


def test_one_of_each_with_repeated_ids(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(7, words), (7, "another text of six words here"), (8, words + " w60"), (9, "another text of six words here"), (5, None), (6, ""), (7, words)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], (r["text"] or "")[:7]) for r in kept.collect()) == [(5, ""), (7, "another"), (7, "w0 w1 w")]


# sharding


def test_shards(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=20_000, fan=3)
    assert store.read().count() == 0 and store.compact() == 0
    rows = lambda a, n: spark.createDataFrame([(k if k % 5 else None, f"text {k} " * 20, a) for k in range(n)], "doc_id long, text string, n int").repartition(2)
    for a in range(7):
        assert store.append(rows(a, 40)) == a + 1
    store.append(rows(7, 0))
    before = sorted(map(repr, store.read().collect()))
    assert len(before) == 280
    small = len(store.manifest()[1])
    store.compact()
    after = store.manifest()[1]
    assert len(after) < small and sorted(map(repr, store.read().collect())) == before
    assert store.plan(after) == [] and store.read(7).count() == 280 and store.read(1).count() == 40
    assert store.vacuum() > 0 and sorted(map(repr, store.read().collect())) == before and store.vacuum() == 0
    base, shards, schema = store.manifest()
    store.commit(base, shards, schema)
    with pytest.raises(sharding.Conflict):
        store.commit(base, [], schema)
    assert sorted(map(repr, store.read().collect())) == before
    assert store.append(rows(8, 10)) > base + 1


def test_several_arrivals_in_one_job(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "t"))
    store.append(spark.range(100).selectExpr("id", "id % 8 as part", "id % 8 as arrival_of"), arrivals="part")
    runs = {s.run for s in store.manifest()[1]}
    assert len(runs) == 8 and store.read().columns == ["id", "arrival_of"]
    store.compact()
    assert len(store.manifest()[1]) == 1 and sorted(r["id"] for r in store.read().collect()) == list(range(100))


def test_arrivals_with_other_columns(spark, tmp_path):
    """What one arrival has and another lacks stays through compaction and vacuum; what does not go together is refused."""
    store = sharding.ShardStore(spark, str(tmp_path / "u"), fan=2)
    store.append(spark.createDataFrame([(1, "a", "en"), (2, None, "de")], "doc_id int, text string, lang string"))
    for k in range(3):
        store.append(spark.createDataFrame([(10 + k, f"t{k}")], "doc_id long, text string"))
    store.append(spark.createDataFrame([("b", 1.5, 20, True)], "TEXT string, score float, Doc_Id long, extra boolean"))
    store.append(spark.createDataFrame([(2.5,)], "score double"))
    names = ["doc_id", "text", "lang", "score", "extra"]
    want = sorted([(1, "a", "en", None, None), (2, None, "de", None, None), (10, "t0", None, None, None), (11, "t1", None, None, None), (12, "t2", None, None, None), (20, "b", None, 1.5, True), (None, None, None, 2.5, None)], key=repr)
    for step in (lambda: None, store.compact, store.vacuum):
        step()
        got = store.read()
        assert got.columns == names and dict(got.dtypes)["doc_id"] == "bigint" and dict(got.dtypes)["score"] == "double"
        assert sorted(map(tuple, got.collect()), key=repr) == want
    files = len(list((tmp_path / "u" / "data").iterdir()))
    with pytest.raises(sharding.SchemaMismatch):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    assert len(list((tmp_path / "u" / "data").iterdir())) == files and store.read().count() == len(want)


def test_vacuum_leaves_running_writers_alone(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, str(tmp_path / "w"), fan=2)
    rows = lambda n: spark.createDataFrame([(n,)], "doc_id long")
    for k in range(3):
        store.append(rows(k))
    inner, met = store._commit, []

    def commit(base, lists, schema):
        if not met:
            met.append(store.vacuum())  # after the shards and lists are written, before they are committed
        return inner(base, lists, schema)

    monkeypatch.setattr(store, "_commit", commit)
    store.append(rows(3))
    assert met == [0] and sorted(r[0] for r in store.read().collect()) == [0, 1, 2, 3]
    met.clear()
    store.compact()
    assert met == [0] and sorted(r[0] for r in store.read().collect()) == [0, 1, 2, 3]
    monkeypatch.undo()
    # a writer that died leaves its mark; its files go when the mark is old
    mark = store._mark()
    store._list(mark, store._write(rows(9), mark))
    before = store.vacuum()
    assert before > 0 and store.vacuum() == 0 and store.vacuum(abandoned_s=0) > 0 and store.vacuum() == 0
    assert sorted(r[0] for r in store.read().collect()) == [0, 1, 2, 3]


def test_a_writer_that_was_away_commits_over_nothing(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "x"))
    stale = store._version()
    for k in range(4):
        store.append(spark.createDataFrame([(k,)], "doc_id long"))
    store.vacuum(version_s=0)
    assert store.versions() == [4]
    with pytest.raises(sharding.Conflict):
        store._commit(stale, [], None)
    assert store.versions() == [4] and store.read().count() == 4


def test_commits_write_the_lists_they_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "LIST_SHARDS", 2)
    store = sharding.ShardStore(spark, str(tmp_path / "y"), target_bytes=500)
    for k in range(5):
        store.append(spark.range(k * 100, k * 100 + 100).repartition(3))
    first = {x.name for x in store._version()["lists"]}
    store.append(spark.range(10))
    assert first < {x.name for x in store._version()["lists"]} and len(first) == 10
    assert store.read().count() == 510 and store.read(3).count() == 300


# the pipeline


def test_pipeline_by_plain_steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    tool = quality.Features()
    kept = [(r["doc_id"], r["text"]) for r in docs.collect() if model.score(*tool(r["text"])) >= quality.THRESHOLD - 1e-6]
    kept.sort()
    whole = distances([t or "" for _, t in kept])
    kept = [kept[k] for k, least in enumerate(groups_of(len(kept), lambda a, b: whole[a, b] <= simhash.most_bits())) if k == least]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {d for d, *_, bad in brute_hits(kept, items) if not bad}
    encoder = bpe.ByteBPE(bpe._vocabulary(None))
    want = {}
    for d, t in kept:
        if d in clean:
            ids = encoder.encode(secretscan.redact_text(t)).tolist()
            want[d] = (len(ids), sha(" ".join(map(str, ids))))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        assert found.count() <= docs.count()


# set apart


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_nothing_else_imports_the_subpackage():
    own = ROOT / "chronofold" / "llm"
    for path in (ROOT / "chronofold").rglob("*.py"):
        if own not in path.parents:
            assert not any(m.startswith("chronofold.llm") or m == "corpus_pipeline" for m in imports(path)), path


def test_native_operators_use_no_python_on_rows():
    for name in ("decontaminate", "sharding"):
        text = (ROOT / "chronofold" / "llm" / f"{name}.py").read_text()
        assert not re.search(r"\budf\b|pandas|pyarrow|mapIn|applyIn|\.rdd\b|mapPartitions", text), name


def test_the_rest_works_without_the_subpackage(tmp_path):
    for item in ("__spark_entry__.py", "chronofold"):
        subprocess.run(["cp", "-r", str(ROOT / item), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "chronofold" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root"}, timeout=120)

"""Every operator on a small table of awkward rows, against SQL or brute force, and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from shoalgrid.llm import bpe, chat, exact_dedup, mixing, pii, quality_rules, registry, simhash, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run(spark, d, name):
    return [r.asDict() for r in registry.queries()[name](spark, d).collect()]


def documents(spark, d):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


def counted(rows, *columns):
    return Counter(tuple(round(v, 6) if isinstance(v := r[c], float) else v for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, fixture_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{fixture_dir}/{t}.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = run(spark, fixture_dir, name)
    assert sorted(got[0]) == columns
    assert counted(got, *columns) == counted([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], *columns)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_table(spark, empty_dir, name):
    got = run(spark, empty_dir, name)
    assert [r["conv_id"] for r in got] == [-1] if name.startswith("op4_") else got == []


def test_simhash_is_the_components_of_all_pairs(spark, fixture_dir):
    def fingerprint(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    docs = [(i, fingerprint(t)) for i, t in documents(spark, fixture_dir)]
    group = list(range(len(docs)))
    for _ in docs:
        before = list(group)
        for i, (_, a) in enumerate(docs):
            for j, (_, b) in enumerate(docs):
                if (a ^ b).bit_count() <= 4:
                    group[i] = min(group[i], group[j])
        if group == before:
            break
    least = defaultdict(list)
    for (i, _), g in zip(docs, group, strict=True):
        least[g] += [i] if i is not None else []
    want = Counter((i, f"{f:016x}", min(least[g], default=None)) for (i, f), g in zip(docs, group, strict=True))
    assert counted(run(spark, fixture_dir, "op8_simhash_near_dedup"), "doc_id", "fingerprint", "component_id") == want


def test_balls_meet_exactly_within_the_radius(spark):
    import random

    rng = random.Random(1)
    some = [rng.getrandbits(64) for _ in range(150)]
    some += [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for x in some]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in set(some)], "fp long")
    mask = (1 << 64) - 1
    edges = {frozenset((r["a"] & mask, r["b"] & mask)) for r in simhash.links(frame).collect()}
    assert all((max(e) ^ min(e)).bit_count() <= 4 for e in edges)
    # Every link is an edge or follows from edges.
    parent = {x: x for x in some}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in map(tuple, edges):
        parent[find(a)] = find(b)
    assert all(find(a) == find(b) for a in some for b in some if 0 < (a ^ b).bit_count() <= 4)


def test_bpe_is_the_library(spark, fixture_dir):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    tok.no_padding()
    tok.no_truncation()
    want = Counter()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in documents(spark, fixture_dir):
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert counted(run(spark, fixture_dir, "op5_bpe"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_on_random_text():
    tokenizers = pytest.importorskip("tokenizers")
    import random

    rng, tok, mine = random.Random(2), tokenizers.Tokenizer.from_file(bpe.vocabulary_path()), bpe.tokenizer(bpe.vocabulary_path())
    alphabet = "aàbcÀéΣσςİIıß中文字1234 \x1c\x85　​\n'sS!?#_-@🙂́ﬁ٣②thereing"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500)] + ["a" * 2000, "!" * 3000, "<|endoftext|>x<|startoftext|>"]
    for text, (n, ids, decoded) in zip(texts, mine.encode_batch(texts), strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), tok.decode(want, skip_special_tokens=False))
        assert mine.decode(map(int, ids.split())) == decoded


BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    holds = (lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15)
    return sorted((k, *m.span()) for k, (p, f) in enumerate(zip(BASE, holds, strict=True)) for m in re.finditer(p, text) if f(m.group()))


def test_base_spans_are_the_patterns(spark, fixture_dir):
    import random

    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("01259@.+- ()ab.@1") for _ in range(rng.randrange(50)))
        assert sorted((k, a, b) for k, a, b, form in pii.search(text) if form == pii.STRICT) == plain(text)
    want = Counter()
    for i, t in documents(spark, fixture_dir):
        spans = plain(t)
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        want[(i, *[sum(s[0] == k for s in spans) for k in range(4)], digest)] += 1
    assert counted(run(spark, fixture_dir, "op7_pii"), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_weak_supervision_adds_what_its_labelers_back():
    strong, weak = pii.pattern_of(3, pii.LOOSE, (0, 2, 2), 4), pii.pattern_of(3, pii.LOOSE, (0, 1, 1), 4)
    counts = {pii.pattern_of(3, pii.STRICT, (2, 2, 2), 4): 500, pii.pattern_of(3, pii.STRICT, (2, 2, 0), 4): 300, strong: 40, weak: 400}
    prior, given, probable = pii.reliabilities(counts)
    scores = pii.classifier(counts, probable)
    assert scores[strong] > pii.THRESHOLD > scores[weak]
    assert pii.resolve([{"kind": 3, "start": 5, "end": 9, "strict": True, "pattern": 0}, {"kind": 2, "start": 8, "end": 20, "strict": False, "pattern": strong}, {"kind": 3, "start": 30, "end": 40, "strict": False, "pattern": strong}], frozenset([strong])) == (
        [(3, 5, 9)],
        [(3, 5, 9), (3, 30, 40)],
    )
    assert pii.redact("call +1 23", "phone:5:10") == "call [phone]"


@pytest.mark.parametrize("name", ["op3_quality_classifier", "op6_toxicity"])
def test_classifiers_score_every_row(spark, fixture_dir, name):
    got = run(spark, fixture_dir, name)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in documents(spark, fixture_dir))
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= (0.3 if name.startswith("op3") else 0.5))


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality_classifier", "quality", 0.95), ("op6_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = [r["predicted"] == labels[r["doc_id"]] for r in run(spark, d, name) if r["held_out"] and r["doc_id"] in labels]
    assert sum(judged) / len(judged) >= least


def test_pairs_outweigh_their_parts():
    rows = [([0], 0), ([1], 0), ([0, 1], 1), ([2], 0)] * 50
    bias, w, v = toxicity.learn(rows, 3)
    machine = toxicity.Machine(bias, w, v)
    assert machine.raw([0, 1]) > 0 > max(machine.raw([0]), machine.raw([1]), machine.raw([2]), machine.raw([]))


def test_substring_dedup_keeps_text(spark):
    long = " ".join(f"p{i}" for i in range(40))
    frame = spark.createDataFrame([(1, f"a {long} b"), (2, f"{long} c d"), (3, "z " * 36), (4, None), (5, " ".join(f"p{i}" for i in range(34)))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(frame).collect()}
    assert got == {1: (40, "a b"), 2: (40, "c d"), 3: (36, ""), 4: (0, ""), 5: (0, " ".join(f"p{i}" for i in range(34)))}


def test_keep_one_of_copies(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    kept = exact_dedup.keep_one(docs).collect()
    want = {}
    for i, t in documents(spark, fixture_dir):
        want[t] = max(want.get(t, -1), -1 if i is None else i)
    assert kept[0].__fields__ == docs.columns
    assert Counter((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in kept) == Counter(want.items())


def test_rows_pass_with_clashing_columns_unchanged(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    for kept in (exact_dedup.keep_one(docs), mixing.mix(docs), quality_rules.accepted(docs), simhash.keep_one(docs)):
        assert kept.columns == docs.columns
        assert kept.exceptAll(docs.union(docs)).count() == 0


def test_shared_keys_are_found_and_few_others(spark):
    docs = spark.createDataFrame([(i, f"text number {i % 900:04d}") for i in range(1000)], "doc_id long, text string")
    many, unique = exact_dedup.survivors(docs)
    assert {r["doc_id"] for r in many.collect()} >= {*range(100), *range(900, 1000)}
    assert unique.columns == docs.columns and unique.count() > 790


def test_added_spans_stay_clear_of_base_spans_and_each_other():
    spans = [(0, 10, True), (5, 30, True), (20, 25, False), (30, 40, False), (35, 45, False), (40, 50, False), (60, 70, True), (50, 61, False)]
    base, every = pii.resolve([{"kind": 0, "start": a, "end": b, "strict": s, "pattern": 1} for a, b, s in spans], frozenset([1]))
    assert base == [(0, 0, 10), (0, 5, 30), (0, 60, 70)]
    assert every == [(0, 0, 10), (0, 5, 30), (0, 30, 40), (0, 40, 50), (0, 60, 70)]


def test_mix_takes_what_it_says(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    decided = run(spark, fixture_dir, "op2_mixing")
    size = lambda t: len(WORD.findall(t))
    mixed = mixing.mix(docs).collect()
    assert sum(size(r["text"] or "") for r in mixed) == sum(r["taken"] for r in decided)
    assert all(r["taken"] <= 2 * r["size"] for r in decided)
    total = sum(r["size"] for r in decided)
    targets = {(r["source_size"], r["target"]) for r in decided}
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6 * total
    assert run(spark, fixture_dir, "op2_mixing") is not None and counted(decided, "doc_id", "taken") == counted(run(spark, fixture_dir, "op2_mixing"), "doc_id", "taken")


def test_parts_are_flattened_in_order(spark):
    parts = [("text", "see ~<image>", None, None), ("image", None, "a.png", 3), ("text", " and ", None, None), ("audio", None, "b.wav", 10), ("odd", "?", None, None), ("document", None, "c.pdf", None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = chat.format_conversations(turns).withColumn("turns", chat.parse(chat.F.col("formatted"))).first()
    assert got["formatted"] == "<s>user[INST]see ~t~p<image> and <audio>?<document></s><s>assistant[/INST]</s>"
    assert [tuple(a) for a in got["attachments"]] == [(0, "image", "a.png", 2 + 3 * 256, ""), (1, "audio", "b.wav", 2 + 250, ""), (2, "document", "c.pdf", 2, "")]
    assert got["expanded_tokens"] == 770 + 252 + 2
    assert [(t["role"], t["trained"]) for t in got["turns"]] == [("user", False), ("assistant", True)]


def test_distances(spark):
    F = quality_rules.F
    row = spark.range(1).select(
        quality_rules.jensen_shannon(F.array(F.lit(2), F.lit(2)), F.array(F.lit(0.5), F.lit(0.5))).alias("same"),
        quality_rules.jensen_shannon(F.array(F.lit(4), F.lit(0)), F.array(F.lit(0.0), F.lit(1.0))).alias("apart"),
        quality_rules.jensen_shannon(F.array(F.lit(0), F.lit(0)), F.array(F.lit(0.0), F.lit(1.0))).alias("none"),
    ).first()
    assert (round(row["same"], 9), round(row["apart"], 9), row["none"]) == (0, 1, 0)


def test_pipeline_stages(spark, fixture_dir):
    """Each stage on its own input: what stays, how often, and that texts pass unchanged."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, fixture_dir), f"test-{name}")
        got[name] = docs.collect()
    kept = counted([r for r in run(spark, fixture_dir, "op1_quality_rules") if r["kept"]], "doc_id")
    assert counted(got["quality_rules"], "doc_id") == kept
    best = {}
    for r in got["quality_rules"]:
        best[r["text"]] = max(best.get(r["text"], -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert {(r["text"], r["doc_id"]) for r in got["exact_dedup"]} == {(t, i) for t, i in best.items()}
    assert {r["doc_id"] for r in got["simhash_near_dedup"]} < {r["doc_id"] for r in got["exact_dedup"]}
    assert sum(200 <= r["doc_id"] < 206 for r in got["simhash_near_dedup"]) == 1
    assert Counter(r["doc_id"] for r in got["bpe"]) == Counter(r["doc_id"] for r in got["source_mix"])
    text = {r["doc_id"]: r["text"] for r in got["source_mix"]}
    mine = bpe.tokenizer(bpe.vocabulary_path())
    for r in got["bpe"]:
        assert mine.encode_batch([text[r["doc_id"]]])[0] == (r["n_tokens"], " ".join(map(str, r["token_ids"])), r["decoded"])

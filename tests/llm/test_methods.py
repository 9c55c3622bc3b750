"""The dealt methods against naive versions: classifiers, weak supervision, exchanges in two steps, the whole pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import personal
import pytest
import xxhash

from shoalgrid.llm import bpe, chat, exact_dedup, mixing, pii, quality_model, quality_rules, registry, simhash, substring_dedup, toxicity

F = quality_rules.F
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def run(spark, d, name):
    return [r.asDict() for r in registry.queries()[name](spark, d).collect()]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def relabelled(spark, d, tmp_path, label):
    """The tables of d with the labels of held-out documents turned round."""
    labels = spark.read.parquet(f"{d}/labels.parquet")
    turned = F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label))
    labels.withColumn(label, turned).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{d}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def taught(spark, d, label):
    """{doc_id: 0 or 1} of the labels that may be learnt."""
    out = {}
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        if r[label] in (0, 1) and not held_out(r["doc_id"]) and r["doc_id"] is not None:
            out[r["doc_id"]] = max(out.get(r["doc_id"], 0), r[label])
    return out


def features_by_hand(text):
    """The classifier's statistics of a text, in the order of quality_model.features()."""
    words = WORD.findall(text)
    n, glued, counted = len(words), "".join(words), Counter()
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    twice = {i + k for i in range(n - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    for c in glued:
        counted[next((k for k, chars in enumerate(quality_rules.CLASSES) if c in chars), 7)] += 1
    counted[8] = len(text) - len(glued)
    chars, per = max(1, len(text)), max(1, n)
    common = sum(w in quality_rules.VOCABULARY for w in words)
    share = lambda k: math.sqrt(counted[k] / chars)
    return [math.log1p(n), math.log1p(len(glued) / per), math.sqrt(len(twice) / per), math.log1p(len(lines) - len(set(lines))), math.sqrt(common / per), *[share(k) for k in (0, 1, 2, 3, 4, 5, 6, 7, 8)]]


@pytest.mark.parametrize("where", ["fixture", SF])
def test_quality_is_the_quadratic_discriminant(spark, fixture_dir, where):
    d = fixture_dir if where == "fixture" else where
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    y = taught(spark, d, "quality")
    x = np.array([features_by_hand(t) for _, t in docs])
    known = np.array([i in y and not held_out(i) for i, _ in docs])
    label = np.array([y.get(i, -1) for i, _ in docs])
    centre, scale = x[known].mean(axis=0), np.sqrt(np.maximum(x[known].var(axis=0), 1e-8))
    z = np.clip((x - centre) / scale, -quality_model.CLIP, quality_model.CLIP)
    density = []
    for k in (0, 1):
        own = (x[known & (label == k)] - centre) / scale
        cov = (1 - quality_model.SHRINKAGE) * np.cov(own, rowvar=False, bias=True) + quality_model.SHRINKAGE * np.eye(x.shape[1])
        away = z - own.mean(axis=0)
        density.append(np.log(len(own)) - np.linalg.slogdet(cov)[1] / 2 - np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) / 2)
    odds = np.clip(density[1] - density[0], -quality_model.LOG_ODDS, quality_model.LOG_ODDS)
    want = sorted((-1 if i is None else i, s) for (i, _), s in zip(docs, 1 / (1 + np.exp(-odds)), strict=True))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in run(spark, d, "op3_quality_classifier"))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-5)


def test_toxicity_is_the_machine_s_definition(spark):
    """Every pair written out; terms read anew from the texts."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    machine = toxicity.fit(rows.select("doc_id", "text"), labels)
    assert len(machine.place) > 1

    def score(text):
        words = {w for token in (text or "").lower().split() for w in re.findall(r"[^\W\d_]+", token)}
        terms = {xxhash.xxh64_intdigest(t.encode(), 7) % toxicity.HASHES for w in words for t in (w, "^" + w[:4], "^" + w[:5])}
        at = [machine.place[t] for t in terms if t in machine.place]
        raw = machine.bias + sum(machine.weights[i] for i in at)
        raw += sum(float(machine.vectors[i] @ machine.vectors[j]) for k, i in enumerate(at) for j in at[:k])
        return 1 / (1 + math.exp(-min(30, max(-30, raw))))

    got = {r["doc_id"]: r["score"] for r in run(spark, SF, "op6_toxicity")}
    want = {r["doc_id"]: score(r["text"]) for r in rows.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


@pytest.mark.parametrize(("name", "label"), [("op3_quality_classifier", "quality"), ("op6_toxicity", "toxic")])
def test_labels_of_the_held_out_fold_say_nothing(spark, tmp_path, name, label):
    other = relabelled(spark, SF, tmp_path, label)
    scores = lambda d: sorted((r["doc_id"], round(r["score"], 9)) for r in run(spark, d, name))
    assert scores(SF) == scores(other)


def naive_spans(texts):
    """[(base spans, all spans)]: every candidate is a row of its own, with its own probability; no table of patterns."""
    rows = []
    for at, text in enumerate(texts):
        for k, a, b, f in pii.search(text):
            rows.append((at, k, a, b, f, pii.votes(text, k, a, b, f), pii.shape(text, k, a, b)))
    p = [1 / (1 + math.exp(-1.5 * sum({0: 0, 1: -1, 2: 1}[v] for v in r[5]))) for r in rows]
    right = {0: (4.0, 1.0), 1: (1.0, 4.0)}
    given = {(j, k, c, v): right[c][v - 1] / 5 for j in range(3) for k in range(5) for c in (0, 1) for v in (1, 2)}
    for _ in range(50):
        prior = {}
        for key in {(r[1], r[4]) for r in rows}:
            mine = [x for x, r in zip(p, rows, strict=True) if (r[1], r[4]) == key]
            prior[key] = (1 + sum(mine)) / (2 + len(mine))
        for j in range(3):
            for k in range(5):
                for c in (0, 1):
                    seen = [right[c][v - 1] + sum(x if c else 1 - x for x, r in zip(p, rows, strict=True) if r[1] == k and r[5][j] == v) for v in (1, 2)]
                    for v in (1, 2):
                        given[j, k, c, v] = seen[v - 1] / sum(seen)
        for i, r in enumerate(rows):
            odds = math.log(prior[r[1], r[4]] / (1 - prior[r[1], r[4]]))
            odds += sum(math.log(given[j, r[1], 1, v] / given[j, r[1], 0, v]) for j, v in enumerate(r[5]) if v)
            p[i] = 1 / (1 + math.exp(-min(30, max(-30, odds))))
    counts = Counter(pii.pattern_of(r[1], r[4], r[5], r[6]) for r in rows)
    mean = defaultdict(float)
    for x, r in zip(p, rows, strict=True):
        mean[pii.pattern_of(r[1], r[4], r[5], r[6])] = x
    scores = pii.classifier(dict(counts), dict(mean))
    out = []
    for at in range(len(texts)):
        mine = [r for r in rows if r[0] == at]
        base, taken = [r[1:4] for r in mine if r[4] == pii.STRICT], []
        for r in sorted((r for r in mine if r[4] != pii.STRICT), key=lambda r: (r[2], -r[3], r[1])):
            apart = all(r[3] <= a or b <= r[2] for _, a, b in base + taken)
            if apart and scores[pii.pattern_of(r[1], r[4], r[5], r[6])] >= pii.THRESHOLD:
                taken.append(r[1:4])
        out.append((sorted(base), sorted(base + taken)))
    return out


def test_spans_of_marked_texts(spark):
    """Added spans against marks made by hand, and the whole column against the naive version."""
    rows = personal.documents()
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    hit = said = real = 0
    for (i, _, marks), (base, every) in zip(rows, naive_spans([r[1] for r in rows]), strict=True):
        assert got[i]["spans"] == pii.written(every)
        assert got[i]["n_added"] == len(every) - len(base)
        assert {(pii.KINDS[k], a, b) for k, a, b in base} == {m[:3] for m in marks if m[3]}
        added, want = {(pii.KINDS[k], a, b) for k, a, b in every} - {(pii.KINDS[k], a, b) for k, a, b in base}, {m[:3] for m in marks if not m[3]}
        hit, said, real = hit + len(added & want), said + len(added), real + len(want)
    assert real > 100 and hit >= 0.9 * said and hit >= 0.9 * real


def test_method_adds_spans_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in run(spark, d, "op7_pii")}
    ids = sorted(texts)
    for i, (_, every) in zip(ids, naive_spans([texts[i] for i in ids]), strict=True):
        assert got[i]["spans"] == pii.written(every)
    held = {i for i, t in texts.items() if re.search(r'(?i)token = "[0-9a-f]{40}"', t)}
    assert held and {i for i, r in got.items() if "secret:" in r["spans"]} == held


def test_equal_rows_are_split(spark):
    """Rows that repeat doc_id and text are taken or left each for itself; so are those that differ in other columns only."""
    for rows in ([(1, "a b c d e f", "x", k % 3) for k in range(100)] + [(2, "a b c", "y", 0)] * 5, [(1, "a b c d e f", "x", 0)] * 40 + [(3, "q " * 7, "z", k) for k in range(9000)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
        decided = mixing.decisions(docs).collect()
        taken, target = Counter(), {}
        for r in decided:
            taken[r["source_size"]] += r["taken"]
            target[r["source_size"]] = r["target"]
        largest = max(len(r[1].split()) for r in rows)
        assert len(decided) == len(rows) and all(abs(taken[s] - target[s]) <= largest / 2 + 1e-9 for s in taken)
        mixed = mixing.mix(docs).collect()
        assert Counter((r["doc_id"], len(r["text"].split())) for r in mixed) == sum((Counter({(r["doc_id"], r["size"]): r["taken"] // r["size"]}) for r in decided), Counter())
        times = Counter(map(tuple, mixed))
        assert all(n <= 2 * Counter(rows)[r] for r, n in times.items())


def test_many_sources_share_by_weight(spark):
    """Against water-filling one source after the other."""
    sizes = {f"s{k:03d}": 1 + k * k % 97 for k in range(300)}
    docs = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    rest, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        rest, free = rest - sum(2.0 * sizes[s] for s in full), free - full
    got = {f"s{r['doc_id']:03d}": r["target"] for r in mixing.decisions(docs).collect()}
    assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 for s in got)


def test_exchanges_in_two_steps_change_nothing(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    texts = lambda df: Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect())
    assert texts(substring_dedup.remove_repeats(docs)) == texts(substring_dedup.remove_repeats(docs, parts=50, coarse=6))
    distinct = simhash.materialize(simhash.fingerprints(docs).select("fp").distinct(), "test")
    edges = lambda df: Counter(map(tuple, df.collect()))
    assert edges(simhash.links(distinct)) == edges(simhash.links(distinct, parts=50, coarse=6))


def test_packed_rows_stay_few_with_many_parts():
    """A hundred thousand parts: in one step a block sends a row for nearly every entry, in two steps a row for every group."""
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 64, 50_000, np.uint64)
    one = substring_dedup.Deal(hashes, 100_000, 1)
    two = substring_dedup.Deal(hashes, 100_000, simhash.groups_of(100_000))
    assert len(one.places) > 30_000 and len(two.places) <= simhash.COARSE
    own = substring_dedup.Super([h.tobytes() for h in np.array_split(hashes, 20)], substring_dedup.ProbeWire(True), 100_000)
    assert sum(own.counts) == 50_000 and len(own.deal.order) == len(np.unique(hashes >> np.uint64(2)))


def test_media_are_parts_and_read_back(spark, fixture_dir):
    turns = spark.read.parquet(f"{fixture_dir}/conversations.parquet").filter("conv_id = 4")
    formatted = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.typed_parts(F.col("text")).alias("parts")))
    got = formatted.withColumn("turns", chat.parse(chat.restore(F.col("formatted"), F.col("attachments")))).first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "x/a.png", 770), ("audio", "b.wav", 27), ("document", "c.pdf", 2050), ("image", "z.jpg", 258), ("image", "y.gif", 258)]
    assert [t["text"] for t in got["turns"]] == [r["text"] for r in turns.orderBy("turn").collect()]
    assert got["formatted"].count("<image>") == 3 and got["expanded_tokens"] == 770 + 27 + 2050 + 258 + 258


def test_references_can_be_given(spark):
    english = "the of and to a in is that it for on with " + " ".join(f"reading number{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{english} w{i}", "en") for i in range(30)], "doc_id long, text string, lang string")
    references = quality_rules.language_references(quality_rules.document_statistics(docs))
    nonsense = " ".join(f"ЖЩ{i}Ъ{i * 7}" for i in range(800))
    odd = spark.createDataFrame([(1, nonsense, None), (2, nonsense, "en"), (3, nonsense, "ru"), (4, english, None)], "doc_id long, text string, lang string")
    kept = lambda **how: {r["doc_id"]: r["kept"] for r in quality_rules.judged(odd, **how).collect()}
    assert kept(references=references) == {1: False, 2: False, 3: True, 4: True}  # ru has no reference
    assert kept()[3] is True
    untagged = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in quality_rules.judged(untagged).filter("class_distance > 0").collect()} == {1, 2, 3, 4}  # one pooled reference


def test_rows_with_clashing_columns_are_encoded(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    got = bpe.encode_documents(docs)
    assert got.columns == [*[c for c in docs.columns if c != "decoded"], "n_tokens", "token_ids", "decoded"]
    assert Counter(map(tuple, got.select("doc_id", "text", "_text", "_n").collect())) == Counter(map(tuple, docs.select("doc_id", "text", "_text", "_n").collect()))


def components(marks, near):
    group = list(range(len(marks)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                if near(a, b) and group[j] > group[i]:
                    group[j], changed = group[i], True
    return group


def test_pipeline_against_brute_force(spark, fixture_dir):
    """All of run()'s rows, from the table alone: SQL for the quality rules, then dictionaries, all pairs, one source after the other, and the tokenizers library."""
    import duckdb

    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{fixture_dir}/documents.parquet/*.parquet'")
    rows = [r.asDict() for r in spark.read.parquet(f"{fixture_dir}/documents.parquet").collect()]
    verdict = Counter((r[0], r[1]) for r in con.sql(f"select doc_id, n_words from ({registry.oracle_sql()['op1_quality_rules']}) where kept").fetchall())
    good = [r for r in rows if verdict[r["doc_id"], len(WORD.findall(r["text"] or ""))]]
    assert len(good) == sum(verdict.values())
    one = {}
    for r in good:
        if r["text"] not in one or (r["doc_id"] is not None and (one[r["text"]]["doc_id"] is None or r["doc_id"] > one[r["text"]]["doc_id"])):
            one[r["text"]] = r
    unique = list(one.values())
    marks = [simhash.fingerprint(r["text"].encode()) for r in unique]
    group = components(marks, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for g, r in zip(group, unique, strict=True):
        least[g] = min(least.get(g, 1 << 62), 1 << 62 if r["doc_id"] is None else r["doc_id"])
    left = [r for g, r in zip(group, unique, strict=True) if r["doc_id"] == least[g]]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in left], "doc_id long, text string, source string")
    con.register("left_over", docs.toPandas())
    mixed = con.sql(mixing.oracle().replace("from documents", "from left_over")).fetchall()
    tok = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    tok.no_padding()
    tok.no_truncation()
    want, text = Counter(), {r["doc_id"]: r["text"] for r in left}
    for doc_id, size, _, _, taken in mixed:
        ids = tok.encode(text[doc_id], add_special_tokens=False).ids
        want[doc_id, len(ids), tuple(ids), tok.decode(ids, skip_special_tokens=False)] += taken // size if size else 0
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["token_ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, fixture_dir).collect())
    assert got == +want
    assert sum(200 <= k[0] < 206 for k in got) == 1


def test_pipeline_on_an_empty_table(spark, empty_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{empty_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, empty_dir)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_of_equal_rows_one_is_kept(spark):
    docs = spark.createDataFrame([(1, "a", k % 2) for k in range(9)] + [(0, "a", 0), (None, "a", 0), (None, "b", 1), (None, "b", 1)], "doc_id long, text string, extra int")
    decided = exact_dedup.decisions(docs).collect()
    assert len(decided) == 13 and Counter((r["keep_id"], r["group_size"]) for r in decided if r["kept"]) == Counter({(1, 11): 1, (None, 2): 1})
    assert Counter((r["doc_id"], r["text"]) for r in exact_dedup.keep_one(docs).collect()) == Counter({(1, "a"): 1, (None, "b"): 1})


def test_scratch_tables_go(spark):
    from pathlib import Path

    from shoalgrid.lineage import drop, shared_dir, swept
    from shoalgrid.operators import stars

    folder = Path(shared_dir(spark)) / f"shoalgrid-{spark.sparkContext.applicationId}"
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    with swept(spark) as keep:
        found = stars.components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
        done = simhash.materialize(found, "test-kept")
        keep.append(done)
    assert {p.name for p in folder.iterdir()} - before == {Path(done._scratch).name}
    assert sorted(map(tuple, done.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    drop(done)
    assert {p.name for p in folder.iterdir()} == before


def test_packed_rows_hold_many_entries_at_six_gigabytes():
    """Six GB of documents are some 1.6 billion words. What a block sends to a task must stay large there, as every row is handled by itself in four places."""
    rng = np.random.default_rng(9)
    text = " ".join(f"w{k}" for k in rng.integers(0, 200_000, 1000).tolist()).encode()
    texts = [b"%d %s" % (k, b" ".join(rng.permutation(text.split()).tolist())) for k in range(substring_dedup.BLOCK_BYTES // len(text) + 1)]
    parts = -(-1_600_000_000 // substring_dedup.TASK_ENTRIES)
    probes = substring_dedup.Probes(substring_dedup.Block(texts), substring_dedup.Layout(parts, 1, 18, 35))
    assert len(probes.hashes) / len(probes.deal.places) > 600


def test_words_in_bytes_are_those_of_split():
    """Word places, hashes and what is kept, against split and join: all separators, long words, empty texts, bytes that only look like separators."""
    rng = np.random.default_rng(4)
    pieces = [*b" |\n|\t|\x0b|\x0c|\r| ".split(b"|"), b"a", b"b", "é".encode(), "　".encode(), b"\0", b"\x1c", b"\x08", b"\x0e", b"x" * 9, b"y" * 70, b"y" * 71]
    for _ in range(200):
        texts = [b"".join(pieces[k] for k in rng.integers(0, len(pieces), rng.integers(0, 30))) for _ in range(rng.integers(0, 6))]
        block, words = substring_dedup.Block(texts), [t.split() for t in texts]
        flat = [w for ws in words for w in ws]
        assert [block.data[a:b].tobytes() for a, b in zip(block.begin, block.end, strict=True)] == flat
        for hashes in (block.hashes.tolist(), block.second.tolist()):
            assert len(set(hashes)) == len(set(flat)) == len(set(zip(hashes, flat, strict=True)))
        keep = rng.random(len(flat)) < 0.6
        counts, kept = block.kept(keep)
        mine = iter(keep.tolist())
        want = [[w for w in ws if next(mine)] for ws in words]
        assert counts.tolist() == [len(ws) for ws in want] and [x.as_buffer().to_pybytes() for x in kept] == [b" ".join(ws) for ws in want]

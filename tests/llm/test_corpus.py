"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weftline.llm import chat_format, decontamination, graph, language_id, lattice, line_dedup, near_dedup, oracles, quality, queries, suffixes, toxicity, vector_index
from weftline.llm import rows as R

KIND = "doc_id long, text string, lang string, source string, n_chars long"
UP = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def prose(rng, n, seed_words="abcdefghijklmnopqrstuvwxyz"):
    return [rng.choice(seed_words) + rng.choice(["lo", "mi", "tar", "ne", "quo", "ves"]) + rng.choice(["", "n", "rex", "d", "sil"]) + rng.choice(["a", "o", "um", "i"]) for _ in range(n)]


def corpus():
    """Texts with exact and near copies, shared passages, nulls, empties, one very long and one without blanks."""
    rng = random.Random(4)
    texts = [" ".join(prose(rng, rng.randrange(60, 200))) for _ in range(30)]
    base = texts[0].split()
    for i in range(6):  # near copies, each with one word of its own
        w = list(base)
        w[5 + 9 * i] = f"changed{i}"
        texts.append(" ".join(w))
    texts += [texts[1]] * 4 + [texts[1].upper()]  # exact copies
    passage = " ".join(prose(rng, 70))
    texts += [" ".join([*prose(rng, 40), passage, *prose(rng, 30)]) for _ in range(3)]
    texts += [None, "", "   \n ", "one", "one two three", "One Two THREE", "x" * 5000, " ".join(prose(rng, 20000)), "Ünïcödé ▁ \U0001f600 text\x0bwith\ttabs", "the same word " * 400]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[3], "en", "s", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def messy(spark):
    """The corpus with extra columns whose names clash with those of the operators."""
    df = spark.createDataFrame(corpus(), KIND)
    return df.withColumns({c: F.lit("clash") for c in ("component_id", "kept", "score", "tokens", "ids", "id", "u", "text2", "sample")}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(rows, percent=85):
    """Brute force: smallest reachable id of each id."""
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in root}


# 1


def test_near_duplicates_equal_brute_force(messy):
    want = classes(corpus())
    got = near_dedup.near_duplicates(messy).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
            assert r.n_shingles == len(shingles(corpus()[r.doc_id][1]))


def test_near_duplicates_with_every_key_hot(messy, monkeypatch):
    monkeypatch.setattr(R, "HOT", 2)
    monkeypatch.setattr(near_dedup.near_duplicates, "__defaults__", (85, 5, near_dedup.BANDS, near_dedup.ROWS, 2))
    test_near_duplicates_equal_brute_force(messy)


def test_dealt_join_equals_a_plain_one(spark):
    many = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(200)], "k int, v int")
    one = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (5, "d"), (None, "e")], "k int, w string")
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(one, ["k"], how).collect()))
        for hot in (1, 50, 1000):
            assert sorted(map(str, R.dealt_join(many, one, ["k"], "v", how, hot=hot).collect())) == want


def test_near_duplicates_chain_without_a_common_centre(spark):
    """Each text is near the next one only: the whole chain is one class."""
    rng = random.Random(8)
    w = prose(rng, 300)
    rows = []
    for i in range(12):
        rows.append((100 - i, " ".join(w)))
        w = w[:]
        w[i * 20] = f"new{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == want
    assert len(set(want.values())) == 1


def test_near_duplicates_of_an_empty_table(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_registers_and_estimate():
    x = np.array([1, 1 << 63, (1 << 63) | (1 << 62), (1 << 20) | (1 << 19)], np.uint64)
    assert (near_dedup.registers(x) >> 10).tolist() == [63, 0, 0, 43]
    assert (near_dedup.registers(x) & 1023).tolist() == [0, 0, 512, 512]
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 1 << 63, 1000).astype(np.uint64)])
    k = 500
    equal = (near_dedup.registers(near_dedup.minima_of(a, k)) == near_dedup.registers(near_dedup.minima_of(b, k))).sum()
    n = np.array([4000])
    assert abs(near_dedup.jaccard_estimate(np.array([equal]), k, n, n)[0] - 3000 / 5000) < 0.1


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 9), (5, 5), (None, 7), (11, 12), (12, 13), (13, 14)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_joined_by_further_links(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(120)]
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long")
    first = graph.components(frame(edges))
    assert sorted(graph.joined(first, frame(more)).collect()) == sorted(graph.components(frame(edges + more)).collect())


def test_components_of_a_long_path_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT", 5)
    ids = random.Random(5).sample(range(1000), 300)
    edges = [*zip(ids[:200], ids[1:201], strict=True), *((ids[250], x) for x in ids[251:])]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: min(ids[:201]) for x in ids[:201]} | {x: min(ids[250:]) for x in ids[250:]}


def test_components_of_few_edges_take_few_jobs_and_equal_those_of_many(spark, monkeypatch):
    rng, status = random.Random(7), spark.sparkContext.statusTracker()
    ids = rng.sample(range(-500, 5000), 300)
    edges = [*((rng.randrange(600), rng.randrange(600)) for _ in range(350)), *zip(ids[:200], ids[1:201], strict=True), (None, 3), (4, 4)]
    frame, got, jobs = spark.createDataFrame(edges, "u long, v long"), [], []
    for most in (graph.PART, 50):
        monkeypatch.setattr(graph, "PART", most)
        spark.sparkContext.setJobGroup(f"components {most}", "")
        got.append(sorted(graph.components(frame).collect()))
        jobs.append(len(status.getJobIdsForGroup(f"components {most}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got[0] == got[1] and len(got[0]) > 400
    assert jobs[0] <= 8 < jobs[1]


def test_every_checkpoint_lets_the_driver_give_memory_back(spark, monkeypatch):
    assert isinstance(R.driver_gives_back(spark), bool)  # not every JVM can
    called = []
    monkeypatch.setattr(R, "driver_gives_back", called.append)
    assert R.steady(spark.range(3)).count() == 3 and called == [spark]


# 2


def test_grammar():
    s = {"insult": toxicity.INSULT, "threat": toxicity.THREAT, "target": toxicity.TARGET, "not": toxicity.NEGATOR, "said": toxicity.REPORT, "so": toxicity.INTENSIFIER, "_": 0}
    kinds = lambda text: [toxicity.KINDS[k] for k in toxicity.clause_matches([s[w] for w in text.split()])]
    assert kinds("target _ insult") == ["insult_aimed_plain_direct"]
    assert kinds("insult _ target") == ["insult_aimed_plain_direct"]
    assert kinds("_ _ insult") == ["insult_bare_plain_direct"]
    assert kinds("target not so insult") == ["insult_aimed_negated_direct"]
    assert kinds("not _ _ _ _ insult") == ["insult_bare_plain_direct"]
    assert kinds("said target _ insult") == ["insult_aimed_plain_reported"]
    assert kinds("_ threat target") == ["threat_aimed_plain_direct"]


def test_grammar_equals_its_definition_on_all_short_clauses():
    """Every clause of up to five symbols, and random longer ones, against the definition of each mark."""
    T = toxicity

    def want(clause):
        out = []
        for i, x in enumerate(clause):
            if x not in (T.INSULT, T.THREAT, T.LEARNED):
                continue
            reach = 0
            for y in clause[:i]:
                reach = T.REACH if y == T.NEGATOR else reach if y == T.INTENSIFIER else max(0, reach - 1)
            aimed = T.TARGET in clause[max(0, i - T.NEAR) : i] or T.TARGET in clause[i + 1 : i + 1 + T.NEAR]
            reported = T.REPORT in clause[:i] or T.REPORT in clause[i + 1 :]
            what = {T.INSULT: "insult", T.THREAT: "threat", T.LEARNED: "learned"}[x]
            out.append("_".join((what, "aimed" if aimed else "bare", "negated" if reach else "plain", "reported" if reported else "direct")))
        return out

    rng = random.Random(9)
    clauses = [list(c) for n in range(6) for c in itertools.product(range(len(T.SYMBOLS)), repeat=n)]
    clauses += [[rng.choice([0, 0, 0, *range(len(T.SYMBOLS))]) for _ in range(rng.randrange(6, 30))] for _ in range(3000)]
    assert all([T.KINDS[k] for k in T.clause_matches(c)] == want(c) for c in clauses)


def test_toxicity_learns_words_and_handles_odd_rows(spark, messy, empty):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, 60)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "grobnik" if i % 8 else "idiot")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, known, F.col("doc_id") < 200).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(200, 400))
    odd = toxicity.toxicity(messy, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(odd) == len(corpus()) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.toxicity(empty, known).count() == 0


def test_toxicity_query_uses_no_held_out_label(spark, data):
    got = queries.op2_toxicity(spark, data).toPandas()
    assert set(got.columns) >= {"doc_id", "held_out", "score", "predicted"}
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got.itertuples())


# 3

ITEM = "today Anna has 12 apples and then gives 5 kg of them to Berta while Anna keeps 7 for the long winter at home"


def test_leaks_verbatim_and_with_other_values(spark, messy, empty):
    bench = spark.createDataFrame([(1, ITEM), (2, "when they saw the red house near the river they stopped and sang until the evening came"), (3, None), (None, "x"), (4, "two words"), (5, "five little words stand here")], "item_id long, text string")
    rng = random.Random(2)
    other = lambda: " ".join(prose(rng, 30))
    texts = {
        10: f"{other()} and {ITEM} {other()}",
        11: f"{other()} and {ITEM.replace('12', '80').replace(' 5 kg', ' 33 kg').replace('7', '9').replace('Berta', 'Carl')} {other()}",
        12: f"{other()} and {ITEM.replace('Anna keeps', 'Dora keeps')} {other()}",  # one name became two: contradictory slots
        13: other(),
        14: f"{other()}, FIVE little  words stand here. {other()}",
        15: "when they saw the red house",
    }
    docs = spark.createDataFrame([*texts.items(), (10, texts[10]), (None, ITEM), (16, None), (17, "")], "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("tokens", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}
    assert (10, 1) in got and got[10, 1].verbatim
    assert (11, 1) in got and not got[11, 1].verbatim and got[11, 1].n_slots >= 3
    assert (12, 1) not in got and (13, 1) not in got and (14, 5) in got and not any(d == 15 for d, _ in got)
    assert decontamination.leaks(messy, bench).count() == 0
    assert decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(docs, bench.where("false")).count() == 0


def test_leaks_of_items_full_of_numbers(spark):
    sums, table = "Compute 12 + 7 - 5 * 3 / 2 + 9", "Add 4, 8, 15, 16, 23, 42, 4, 8, 99 and then 3 5 7 11 13"
    bench = spark.createDataFrame([(1, sums), (2, table)], "item_id long, text string")
    rng = random.Random(3)
    other = lambda: " ".join(prose(rng, 12))
    texts = [f"{other()} 31 {other()}. {sums} {other()}", f"{other()}. {sums.replace('3', '4')} {other()}", f"{table}", f"{other()} 5 6 {table} 7 {other()}", f"{other()}. {table.replace('8', '6').replace('11', '12')}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}
    assert {(0, 1), (2, 2), (3, 2)} == set(got)
    assert all(r.verbatim and r.coverage == 1 for r in got.values())


HARD = [
    ("a", "Anna has 12 apples and gives 5 of them to Berta. How many apples does Anna have left now?"),
    ("b", "What is 12 + 45 * 3 - 7 / 2 + 19 * 4 - 8"),
    ("c", "Define entropy"),
    ("d", "?!"),
    ("e", "New York lies 300 km from Boston and 20 miles from the sea"),
    ("e", "Name five of the rivers that flow through Paris or London today"),
]


def hard_documents():
    a, b, e = HARD[0][1], HARD[1][1], HARD[4][1]
    texts = [
        a.replace("Anna", "Carla").replace("Berta", "Dora").replace("12", "15").replace("5 of", "9 of"),  # names at the beginnings of sentences
        a.replace("Anna", "Carl").replace("Berta", "Carl"),  # two names became one
        f"see. {b}, then", f"see. {b.replace('45', '46')}, then",
        "Define entropy.\nok", "please define entropy now", "DEFINE ENTROPY",
        a.lower(), a.upper(), e.replace("New York", "Rome").replace("300 km", "4.5 miles").replace("20 miles", "20 feet"),
        "the " + "Foo " * 20000, "Foo" * 20000, "1" * 1_000_000, "7 ,." * 100_000, "km " * 20000, "5 km " * 20000, "The " * 20000, HARD[5][1],
    ]
    return list(enumerate(texts))


def test_leaks_of_hard_items_and_texts_of_any_length(spark):
    bench = spark.createDataFrame([*HARD, HARD[0]], "item_id string, text string").withColumn("doc", F.lit("clash"))
    docs = spark.createDataFrame([*hard_documents(), hard_documents()[0]], "doc_id int, text string").withColumn("raw", F.lit("clash"))
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(0, "a"): False, (2, "b"): True, (4, "c"): True, (6, "c"): True, (7, "a"): True, (8, "a"): True, (9, "e"): False, (17, "e"): True}
    assert dict(decontamination.leaks(docs, bench.where("false")).dtypes)["item_id"] == "string"


def test_leaks_equal_their_sql_on_hard_cases(spark, duck):
    docs, bench = ([r for r in rows if len(r[1]) < 100_000] for rows in (hard_documents(), [(i, t) for i, (_, t) in enumerate(HARD)]))
    con = duck.cursor()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", bench)):
        con.execute(f"create or replace temp table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert rows_of(found.toPandas()) == rows_of(con.execute(oracles.decontamination_sql()).df())


def test_windows_dealt_over_tasks_give_the_same(spark, data, monkeypatch):
    want = rows_of(queries.op3_decontamination(spark, data).toPandas())
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert rows_of(queries.op3_decontamination(spark, data).toPandas()) == want


def test_leaks_find_every_planted_item(spark, data):
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text}
    assert want <= got


# 4


@pytest.fixture(scope="module")
def tiny():
    pieces = {1: b"a", 2: b"b", 3: b" ", 4: b"ab", 5: b" a", 6: b"ba", 7: b"aba"}
    p = {1: 0.2, 2: 0.2, 3: 0.1, 4: 0.2, 5: 0.1, 6: 0.1, 7: 0.1}
    return lattice.Vocabulary(pieces, {i: math.log(x) for i, x in p.items()}, list(range(100, 356))), pieces, p


def paths(text, pieces, p):
    """All segmentations of a text with their probabilities, by enumeration."""
    out = {}

    def go(at, ids, q):
        if at == len(text):
            out[tuple(ids)] = q
        for i, piece in pieces.items():
            if text.startswith(piece, at):
                go(at + len(piece), [*ids, i], q * p[i])

    go(0, [], 1.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def sample(voc, text, key, k):
    b = np.frombuffer(text.encode(), np.uint8)
    return lattice.sample_chunk(voc, b, np.array([0, len(b)]), np.array([key], np.uint64), k)[0]


def test_samples_follow_the_posterior_without_replacement(tiny):
    voc, pieces, p = tiny
    want = paths(b" abab a", pieces, p)
    first, pairs, n = Counter(), Counter(), 4000
    for key in range(n):
        got = [tuple(s[0].tolist()) for s in sample(voc, "abab a", key * 7919 + 1, 2)]
        assert len(set(got)) == 2
        first[got[0]] += 1
        pairs[tuple(got)] += 1
    for path, q in want.items():
        assert abs(first[path] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
    for (a, b), c in pairs.items():  # the second is drawn from what the first left
        q = want[a] * want[b] / (1 - want[a])
        assert abs(c / n - q) < 5 * math.sqrt(q / n) + 2e-3


def test_all_segmentations_come_out_in_order(tiny):
    voc, pieces, p = tiny
    want = paths(b" aba", pieces, p)
    got = sample(voc, "aba", 5, 50)
    assert {tuple(s[0].tolist()) for s in got} == set(want)
    assert [s[2] for s in got] == sorted((s[2] for s in got), reverse=True)
    assert all(abs(math.exp(s[1]) - want[tuple(s[0].tolist())]) < 1e-9 and s[3] == 1.0 for s in got)


def test_siblings_held_as_one_are_dealt_out(tiny, monkeypatch):
    voc, pieces, p = tiny
    monkeypatch.setattr(lattice, "_FAR", -0.5)
    monkeypatch.setattr(lattice, "_AHEAD", 1)
    test_samples_follow_the_posterior_without_replacement(tiny)
    test_all_segmentations_come_out_in_order(tiny)
    test_inclusion_scores_make_unbiased_sums(tiny)


def test_pieces_of_several_blanks_and_across_blanks():
    for pieces in ({1: b"a", 2: b" ", 3: b"  ", 4: b"   ", 5: b" a", 6: b"  a"}, {1: b"a", 2: b" ", 3: b"a a", 4: b"a "}):
        p = {i: 1 / len(pieces) for i in pieces}
        voc = lattice.Vocabulary(pieces, {i: math.log(x) for i, x in p.items()}, list(range(100, 356)))
        want = paths(b" a   aa a", pieces, p)
        got = sample(voc, "a   aa a", 11, 10_000)
        assert {tuple(s[0].tolist()) for s in got} == set(want)
        assert all(abs(math.exp(s[1]) - want[tuple(s[0].tolist())]) < 1e-9 for s in got)
    voc = lattice.Vocabulary.load(queries.PIECES)
    assert not voc.crossing
    found = sample(voc, "x" + " " * 8 + "y", 3, 40)
    assert any(voc.decode([0, i]).isspace() and voc.piece_len[i] > 1 for s in found for i in s[0].tolist())


def chunk_samples(voc, texts, k=3, **more):
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    found = lattice.sample_chunk(voc, np.frombuffer(b"".join(data), np.uint8), bounds, np.arange(5, 5 + len(data), dtype=np.uint64), k, **more)
    return [[(s[0].tolist(), *s[1:]) for s in t] for t in found]


def test_what_has_been_built_is_not_built_again(monkeypatch):
    """Chunks after one another look up only rests of units that are new, and their samples are the same to the last bit."""
    voc = lattice.Vocabulary.load(queries.PIECES)
    looked, find = [], lattice.Vocabulary.find
    monkeypatch.setattr(lattice.Vocabulary, "find", lambda self, keys: looked.append(len(keys)) or find(self, keys))
    rng = random.Random(4)
    texts = [" ".join(prose(rng, 200)) + " öß 日本\n語 \U0001f600  x" for _ in range(4)]
    want = chunk_samples(voc, texts)
    alone = sum(looked)
    looked.clear()
    known = lattice.Lattice(voc)
    assert chunk_samples(voc, texts, lattice=known) == want and sum(looked) == alone
    looked.clear()
    assert chunk_samples(voc, texts, lattice=known) == want and sum(looked) == 0
    ends = ["singing", "bringing", "clinging"]  # rests that units share are built once
    looked.clear()
    chunk_samples(voc, [" ".join(ends)])
    together = sum(looked)
    looked.clear()
    for e in ends:
        chunk_samples(voc, [e])
    assert together < 0.8 * sum(looked)


def test_samples_do_not_depend_on_what_is_kept(monkeypatch):
    """Kept rests are let go beyond a bound; neither that nor the size of what is built at once changes a bit."""
    voc = lattice.Vocabulary.load(queries.PIECES)
    rng = random.Random(9)
    chunks = [[" ".join(prose(rng, 150)) for _ in range(3)] + ["é" * 50, "", "\U0001f600" * 9] for _ in range(4)]
    known = lattice.Lattice(voc)
    want = [chunk_samples(voc, c, lattice=known) for c in chunks]
    for bound, build, table in ((0, 1 << 17, 17), (1 << 20, 1, 2), (2000, 64, 1)):
        monkeypatch.setattr(lattice, "_KNOWN", bound)
        monkeypatch.setattr(lattice, "_BUILD", build)
        monkeypatch.setattr(lattice, "_TABLE", table)
        known = lattice.Lattice(voc)
        for c, w in zip(chunks, want, strict=True):
            assert chunk_samples(voc, c, lattice=known) == w
            if not bound:
                one = lattice.Lattice(voc)
                chunk_samples(voc, c, lattice=one)
                assert len(known.id) == len(one.id)


def test_inclusion_scores_make_unbiased_sums(tiny):
    voc, pieces, p = tiny
    want = paths(b" abab", pieces, p)
    mean = sum(q * len(path) for path, q in want.items())
    est = [sum(math.exp(s[1]) / s[3] * len(s[0]) for s in sample(voc, "abab", key * 31 + 7, 3)) for key in range(3000)]
    assert abs(np.mean(est) - mean) < 5 * np.std(est) / math.sqrt(len(est))


def test_segmentations_spell_their_texts(spark, messy, empty):
    voc = lattice.Vocabulary.load(queries.PIECES)
    got = lattice.sample_segmentations(messy, voc, 3).collect()
    texts = defaultdict(list)
    for r in corpus():
        texts[r[0]].append(r[1] or "")
    for r in got:
        assert r.decoded
        if r.doc_id is not None:
            want = texts[r.doc_id][0]
            assert (voc.decode(r.ids) if r.ids else "") == want
    assert all(len({tuple(r.ids) for r in got if r.doc_id == i}) == 3 for i in range(20) if i != 2)
    spelt = lattice.decode_segmentations(lattice.sample_segmentations(messy, voc, 2).withColumn("text", F.lit("clash")), voc).collect()
    assert all(r.text == texts[r.doc_id][0] for r in spelt if r.doc_id is not None) and len(spelt) > len(texts)
    again = lattice.sample_segmentations(messy.repartition(1), voc, 3).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["sample"], tuple(r.ids))
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert lattice.sample_segmentations(empty, voc).count() == 0


# 5


def test_chat_grammar_round_trip():
    rng = random.Random(1)
    bits = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "[", "/", "]", "a", "[ROLE:", "[/ROLE]", "[REPLY]", "[/REPLY]", "\n", "s", "<", ">", "é"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "x]y\\", "[ROLE:"]), "".join(rng.choices(bits, k=rng.randrange(9)))) for _ in range(3)]
        rendered = "".join(chat_format.format_turn(*t)[0] for t in turns)
        assert [t[:2] for t in chat_format.parse(rendered)] == turns
    for bad in ("x", "<s>", "<s>[INST]a</s>", "<s>[INST]a<s>[/INST]</s>", "<s>[INST]a[/INST]"):
        with pytest.raises(ValueError):
            chat_format.parse(bad)


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "b\\n"), (1, 0, "user", None), (1, 2, None, "</s>"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, "user", "q"), (3, 5, "assistant", "é" * 70000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash")).repartition(4)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    turns = {1: [("user", ""), ("assistant", "b\\n"), ("", "</s>")], 2: [("assistant", "x")] * 2, None: [("user", "q")], 3: [("assistant", "é" * 70000)]}
    assert set(got) == set(turns)
    for c, want in turns.items():
        learned = "".join(t for r, t in want if r == "assistant")
        assert got[c].n_turns == len(want) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_conversations(df.where("false"))).count() == 0


def test_chat_query_has_the_extra_conversation(spark, data):
    got = {r.conv_id: r for r in queries.op5_chat_format(spark, data).collect()}
    text = "</s>[INST] ok [/INST]"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(text) and got[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == 1 + spark.read.parquet(f"{data}/conversations.parquet").select("conv_id").distinct().count()


# 6


def exact(rows, queries_of, k=10):
    use = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in sorted(use):
        if queries_of(q):
            d = sorted((math.sqrt(((use[q] - v) ** 2).sum()), i) for i, v in use.items() if i != q)
            out[q] = d[:k]
    return out


def test_neighbours_on_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))]
    rows += [(100, [0.0] * 8), (101, None), (102, [1.0, None] * 4), (103, [float("nan")] * 8), (104, [float("inf")] * 8), (105, []), (None, rows[3][1]), (106, rows[3][1]), (107, rows[3][1]), (108, [1.0, 2.0])]
    df = spark.createDataFrame([*rows, rows[5]], "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 108]
    want = exact(as_float, lambda i: i % 10 == 0)
    got = defaultdict(list)
    for r in vector_index.search(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(abs(a[0] - b[0]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))
    assert vector_index.search(df.where("false"), F.lit(True)).count() == 0
    assert vector_index.search(df.where("vec_id = 1"), F.lit(True)).count() == 0


def recall(spark, x, queries=30):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    step = len(x) // queries
    found = vector_index.search(df, F.col("vec_id") % step == 0).collect()
    hit = 0
    for q in range(0, len(x), step):
        d = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10]) & {r.vec_id for r in found if r.query_id == q})
    assert len(found) == 10 * len(range(0, len(x), step))
    return hit / len(found)


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(2)
    assert recall(spark, rng.normal(size=(3000, 32)).astype(np.float32)) >= 0.9


@pytest.mark.parametrize("n", [2000, 20_000])
def test_recall_with_and_without_clusters(spark, n):
    rng = np.random.default_rng(n)
    assert recall(spark, rng.normal(size=(n, 64)).astype(np.float32)) >= 0.9
    centres = 4 * rng.normal(size=(n // 100, 64))
    assert recall(spark, (centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 64))).astype(np.float32)) >= 0.9


def test_clusters_need_few_probes():
    rng = np.random.default_rng(6)
    centres = 10 * rng.normal(size=(50, 16))
    x = centres[rng.integers(0, 50, 4000)] + rng.normal(size=(4000, 16))
    few = vector_index.Quantiser(x, 64)
    many = vector_index.Quantiser(rng.normal(size=(4000, 16)), 64)
    assert few.probes(x, 10, 0.97) <= 8 < many.probes(rng.normal(size=(4000, 16)), 10, 0.97)


# 7


def test_cotraining_beats_chance_and_handles_odd_rows(spark, messy, empty, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = quality.fit(docs, labels)
    assert len(model.taken) == quality.ROUNDS
    got = quality.score(docs, model).join(labels, "doc_id").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.85
    assert quality.score(messy, model).count() == len(corpus()) and quality.score(empty, model).count() == 0
    blank = quality.fit(messy, labels.where("false"))
    assert {r.score for r in quality.score(messy.select("doc_id", "text"), blank).collect()} == {0.5}


def test_cotraining_on_rows_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    seen = ~language_id.held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs, labels.where(seen))
    got = quality.score(docs, model).join(labels.where(~seen), "doc_id").toPandas()
    assert len(got) > 100
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.85
    assert all(a + b > 0 for a, b in model.taken)


def test_views_share_no_input(spark):
    import pyarrow as pa

    (chunk,) = R.text_chunks(pa.array(["a b\n1", ""]))
    assert quality.text_view(chunk).shape == (2, quality.DIMS + 11)
    a = quality.meta_view(["s", None, "s"], ["en", "None", "en"], [7, None, 8])
    assert not (a[0] == a[2]).all() and not (a[0] == a[1]).all() and a[1, 0] == 1


def test_cotraining_with_labels_of_one_class_and_repeated_rows(spark, messy):
    one = spark.createDataFrame([(i, 1) for i in range(12)] + [(3, 1), (None, 0), (4, None)], "doc_id long, quality int")
    model = quality.fit(messy.unionAll(messy), one)
    assert model.taken == [] and quality.score(messy, model).where("score is null or score < 0 or score > 1").count() == 0


# 8


def repeated_windows(rows, n=50):
    seen = defaultdict(set)
    for i, t in {r[0]: r[1] for r in rows if r[0] is not None and r[1]}.items():
        w = words_of(t)
        for a in range(len(w) - n + 1):
            seen[tuple(w[a : a + n])].add((i, a))
    return {p for v in seen.values() if len({i for i, _ in v}) > 1 for p in v}


def test_passages_equal_brute_force(messy, empty):
    want = defaultdict(set)
    for i, a in repeated_windows(corpus()):
        want[i].update(range(a, a + 50))
    got = defaultdict(set)
    for r in suffixes.repeats(messy).collect():
        assert r.b - r.a >= 50
        got[r.doc_id].update(range(r.a, r.b))
    for i, cover in want.items():
        assert i in got and cover <= got[i]
    alone = {i for i in got if i not in want}  # repeats within one text
    assert alone <= {next(r[0] for r in corpus() if r[1] and r[1].startswith("the same word"))}
    assert suffixes.passages(empty).count() == 0


def test_passages_come_with_their_text(messy):
    text = {r[0]: r[1] for r in corpus() if r[0] is not None}
    found = suffixes.passages(messy).collect()
    first = {}
    for r in sorted(found, key=lambda r: r.doc_id):
        for s in r.repeated:
            piece = " ".join(words_of(text[r.doc_id][s.at : s.end]))
            assert len(piece.split()) >= 50
            first.setdefault(piece, r.doc_id)
        assert all(any(s.at <= c.at and c.end <= s.end for s in r.repeated) for c in r.removed)
    assert any(not r.removed for r in found) and any(r.removed for r in found)


def test_many_suffixes_in_one_group(spark):
    """A passage in very many documents stays one chain over several partitions."""
    rng = random.Random(5)
    passage = " ".join(prose(rng, 60))
    rows = [(i, f"{' '.join(prose(rng, 10))} {passage} {' '.join(prose(rng, 10))}") for i in range(300)]
    got = suffixes.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len(got) == 300 and sum(bool(r.removed) for r in got) == 299


def test_every_repeated_window_and_its_first_occurrence(spark):
    """Left parts that only a suffix far off in the order shares, and later copies between other neighbours."""
    rng = random.Random(8)
    texts = []
    for _ in range(20):
        mid, lefts, rights = prose(rng, 60), [prose(rng, 14) for _ in range(2)], [prose(rng, 40) for _ in range(2)]
        texts += [[*prose(rng, 9), *left, *mid, *right, *prose(rng, 5)] for left in lefts for right in rights]
    rng.shuffle(texts)
    seen = defaultdict(list)
    for i, w in enumerate(texts):
        for a in range(len(w) - 49):
            seen[tuple(w[a : a + 50])].append((i, a))
    want, later = ({(i, p) for v in seen.values() if len(v) > 1 for i, a in v[k:] for p in range(a, a + 50)} for k in (0, 1))
    spans = suffixes.repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(r.doc_id, p) for r in spans for p in range(r.a, r.b)} == want
    assert {(r.doc_id, p) for r in spans if r.again for p in range(r.a, r.b)} == later


# 9


def test_lines_and_sentences(spark, messy, empty):
    line = "this line of eight words is repeated here"
    long = "This sentence holds more than ten words, so that it counts alone."
    rows = [(1, f"{line}\nfirst own text of this document\nyes"), (2, f"x\n  THIS line of   eight words is repeated here \nyes"), (3, f"Some start of words. {long} Then an end."), (4, f"Others begin. {long}"), (5, line), (6, None), (7, ""), (None, line)]
    df = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string").withColumn("at", F.lit("clash"))
    units = line_dedup.repeated_units(df)
    text = dict(r for r in rows if r[0])
    cut = {r.doc_id: [text[r.doc_id][s.at : s.end] for s in r.removed] for r in line_dedup.removals(units).collect()}
    assert cut == {2: ["THIS line of   eight words is repeated here"], 4: [long], 5: [line]}
    left = [(r.doc_id, r.text) for r in line_dedup.remove_repeats(df, units).collect()]
    assert len(left) == len(rows) + 1 and dict(left)[5] == "" and dict(left)[6] is None and (None, line) in left
    assert "eight" not in dict(left)[2] and dict(left)[1] == text[1] and dict(left)[3] == text[3]
    assert line_dedup.remove_repeats(messy, line_dedup.repeated_units(messy)).count() == len(corpus())
    assert line_dedup.repeated_units(empty).count() == 0


def test_cut_keeps_offsets():
    assert line_dedup.without("abc def ghi", [(0, 3), (2, 4)]) == ("def ghi", [(4, 11)])
    assert line_dedup.without("abc", [(0, 3)]) == ("", [])


# 10


def test_languages(spark, messy, empty, data):
    got = queries.op10_language(spark, data).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas().set_index("doc_id")
    held = got[got["held_out"]]
    assert (held["lang_pred"] == docs["lang"].loc[held.index]).mean() > 0.93
    assert all(got["held_out"] == [crc32(str(i).encode()) % 4 == 2 for i in got.index])
    model = language_id.fit(spark.read.parquet(f"{data}/documents.parquet"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !? \U0001f600"), (4, "the"), (None, "the of and")], "doc_id long, text string").withColumn("lang", F.lit(1))
    rows = language_id.identify(odd, model).collect()
    assert [r.lang_pred == "und" for r in rows] == [True, True, True, False, False] and [r.accepted for r in rows][:3] == [False] * 3
    assert language_id.identify(messy, model).count() == len(corpus()) and language_id.identify(empty, model).count() == 0
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.accepted_rows(messy, model).columns == messy.columns


def test_letters_are_those_of_unicode(spark, data):
    import pyarrow as pa

    points = [p for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000]
    found = np.concatenate([language_id.has_letters(c) for c in R.text_chunks(pa.array([chr(p) + "1 ?" for p in points]))])
    assert [p for p, l in zip(points, found, strict=True) if l != unicodedata.category(chr(p)).startswith("L")] == []
    odd = ["١٢٣ ٤٥٦", "؟؟؟ ٪", "१२३ ।", "๑๒๓", "𝟙𝟚", "ℝ ℂ", "ªa", "一二", None]
    model = language_id.fit(spark.read.parquet(f"{data}/documents.parquet"))
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert [got[i].lang_pred == "und" for i in range(9)] == [True] * 5 + [False] * 3 + [True]
    assert all(0 <= r.score <= 1 for r in got.values())
    few = language_id.fit(spark.read.parquet(f"{data}/documents.parquet"), languages=2)
    assert len(set(few.langs)) == 2


# All


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(name, spark, data, duck):
    assert rows_of(queries.queries()[name](spark, data).toPandas()) == rows_of(duck.execute(oracles.oracle_sql()[name]).df())


def test_pipeline(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    now, seen = docs, []
    for i, (_, stage) in enumerate(P.STAGES):
        now = stage(spark, now, data).cache()
        seen.append(now)
        if i < len(P.STAGES) - 1:
            assert now.schema.names == docs.schema.names
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert len(text) >= len(ids[0]) > len(ids[1]) >= len(ids[2]) > len(ids[3]) == len(ids[4])
    assert len(ids[0]) > 0.98 * len(text)
    bench = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert not any(b in r.text for r in seen[3].collect() for b in bench)
    want = classes([(i, text[i]) for i in sorted(ids[0])], P.NEAR_PERCENT)
    assert ids[1] == {i for i in ids[0] if want[i] == i}
    assert P.run(spark, data).count() == seen[4].count()


def test_pipeline_drops_near_copies_from_80_percent_on(spark, data):
    import corpus_pipeline as P

    rng = random.Random(31)
    rows = []
    for i in range(20):
        w = prose(rng, 300)
        rows.append((2 * i, " ".join(w)))
        for at in range(6 + i % 3):
            w[30 * at + 7] = f"own{i}x{at}"
        rows.append((2 * i + 1, " ".join(w)))
    near = [len(shingles(a[1]) & shingles(b[1])) / len(shingles(a[1]) | shingles(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert sum(0.80 <= x < 0.85 for x in near) >= 5 and min(near) < 0.80
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in P.drop_near_duplicates(spark, docs, data).collect()}
    assert got == {2 * i for i in range(20)} | {2 * i + 1 for i in range(20) if near[i] < 0.80}


def test_pipeline_stages_on_odd_rows(spark, messy, empty, data):
    import corpus_pipeline as P

    n = len(corpus())
    for name, stage in P.STAGES:
        got = stage(spark, messy, data)
        if name != "segmentation":
            assert got.schema.names == messy.schema.names
            found = Counter((r.doc_id, r.lang) for r in got.collect())
            odd = {"language identification": [], "near-duplicate removal": [(None, "en"), (None, None), (32 + 14, "en")]}.get(name, [(None, "en"), (None, None)])
            assert all(found[k] >= 1 for k in odd) and sum(found.values()) <= n
            assert name != "repeated-text removal" or sum(found.values()) == n
        else:
            assert got.select("doc_id").distinct().count() == len({r[0] for r in corpus()})
        assert stage(spark, empty, data).count() == 0


def test_pipeline_cuts_passages_of_short_units(spark, data):
    """Repeated passages of short sentences and short lines, and one that begins and ends inside a sentence."""
    import corpus_pipeline as P

    rng = random.Random(12)
    w = prose(rng, 180)
    short = " ".join(" ".join(w[i : i + 4]) + "." for i in range(0, 60, 4))
    lines = "\n".join(" ".join(w[i : i + 3]) for i in range(60, 120, 3))
    inner = " ".join(w[120:])
    own = lambda: " ".join(prose(rng, 15))
    rows = [(10 * k + i, f"{own()} {p} {own()}") for i, p in enumerate((short, lines, inner)) for k in (1, 2)]
    text = dict(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], KIND)
    left = {r.doc_id: r for r in P.drop_repeated_units(spark, docs, data).collect()}
    assert len(left) == 6
    for i in range(3):
        before, now = words_of(text[20 + i]), words_of(left[20 + i].text)
        assert left[10 + i].text == text[10 + i] and left[20 + i].n_chars == len(left[20 + i].text)
        assert len(before) == 90 and set(now) <= set(before[:15] + before[-15:]) and len(now) >= 28


def test_words_and_hashes_are_position_free():
    import pyarrow as pa

    texts = ["Ab  cd\tAB", None, "", "cd ab\x0b", " ab"]
    (chunk,) = R.text_chunks(pa.array(texts))
    starts, ends, firsts = R.words(chunk)
    h = R.word_hashes(chunk, starts, ends)
    assert np.diff(firsts).tolist() == [len(words_of(t)) for t in texts]
    assert h[0] == h[2] == h[4] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 2

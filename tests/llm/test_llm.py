import os
import random
import time
import unicodedata
from collections import Counter
from fractions import Fraction

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tramsu.functions.text import fold_words
from tramsu.llm import answers, contamination, leaks, overlap, pieces, quality, questions, same, sampling, splitting, tokenize, variants
from tramsu.llm import queries as Q


def canon(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(list(map(canon, v))) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in "corpus qa_pairs entities exam_dashboard documents exam_items nicknames exam_blueprint".split():
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    cols = sorted(want.columns)
    got = Q.queries()[name](spark, data)
    assert sorted(canon([r[c] for c in cols]) for r in got.collect()) == sorted(canon([r[want.columns.index(c)] for c in cols]) for r in want.fetchall())


COLUMNS = {
    "p1_found": "surface_a string, surface_b string", "p2_found": "blueprint_id int, bloom string", "p3_found": "record_kind string, key_a string, key_b string",
    "p4_found": "context_id string", "p5_found": "item_id string, defect string", "p6_found": "context_id string", "p7_found": "item_id_a string, item_id_b string",
    "p8_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint, id string", "p10_found": "doc_id bigint, kind string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_has_its_columns_on_full_and_empty_tables(spark, data, name, tmp_path):
    got = Q.queries()[name](spark, data)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == COLUMNS[name]
    rows = got.collect()
    assert len(rows) == len({canon(tuple(r)) for r in rows})
    for t in os.listdir(data):
        spark.read.parquet(f"{data}/{t}").limit(0).write.parquet(str(tmp_path / t))
    assert Q.queries()[name](spark, str(tmp_path)).count() == 0


# --- p1


def test_likelihood_tells_variants_from_kin():
    yes = [("u. neisvaex beildmink|", "ulderika neisvaex beildmink|"), ("dorothild treis. feivbaenk|", "dorothild treisgrim feivbaenk|"), ("noan giuat toai|", "noan giuat dinh toai|"),
           ("feoddrik klirtraerd stethpird|", "feodrik klirtraerd stethpird|"), ("lex raeth graeldklux|", "lexraeth graeldklux|"), ("giam q. t. voi|", "giam quom toc voi|")]
    no = [("ekkehild klembith monklum|iii", "ekkehild klembith monklum|iv"), ("goach nghenh chuat thang|", "goach chuat nghenh thang|"), ("valdemira x y|", "radomira x y|"), ("sech khinh xom loan|", "sech kham gioai loan|")]
    assert all(variants.likelihood(a, b) is not None for a, b in yes)
    assert all(variants.likelihood(a, b) is None for a, b in no)
    assert all(variants.blocks(a) & variants.blocks(b) for a, b in yes)


def test_entities(spark):
    rows = (
        [("Ekkehild Klembith Monklum III", "PER")] * 9 + [("Ekkehild Klembith Monklum IV", "PER")] * 4
        + [(s, "PER") for s in ("Ekka Klembith Monklum III", "Vua Ekkehild Klembith Monklum III", "EKKEHILD KLEMBITH MONKLUM III", "Monklum III, Ekkehild Klembith", "Ekkehild Klembitth Monklum III")]
        + [(f"Viện Sử Học {w} Drel", "ORG") for w in ("Aba", "Bebo", "Cici", "Dodo")] * 3 + [("VSH.Aba Drel", "ORG"), ("Aba Drel – Viện Sử Học", "LOC"), ("##abc", "PER"), (None, "PER"), ("năm 1945", "YEAR")]
        + [("đèo Trimtraem Namgel", "LOC")] * 3 + [("deo trimtraem namgel", "LOC"), ("Trimtraem-Namgel", "LOC"), ("Trimtraem Namgel (đèo)", "LOC")]
    )
    m = spark.createDataFrame([(*r, 1) for r in rows], "surface string, type string, n int")
    nick = spark.createDataFrame([("Ekkehild", "Ekka"), (None, "x")], "given string, nickname string")
    got = {}
    for r in variants.entities(m, nick).collect():
        got.setdefault(r["entity"], set()).add(r["surface"])
    groups = {frozenset(g) for g in got.values()}
    third = next(g for g in groups if "Ekkehild Klembith Monklum III" in g)
    assert {"Ekka Klembith Monklum III", "Vua Ekkehild Klembith Monklum III", "EKKEHILD KLEMBITH MONKLUM III", "Ekkehild Klembitth Monklum III"} <= third and "Ekkehild Klembith Monklum IV" not in third
    assert frozenset({"đèo Trimtraem Namgel", "deo trimtraem namgel", "Trimtraem-Namgel", "Trimtraem Namgel (đèo)"}) in groups
    assert frozenset({"Viện Sử Học Aba Drel", "VSH.Aba Drel", "Aba Drel – Viện Sử Học"}) in groups
    assert not any("##abc" in g or "năm 1945" in g for g in groups)


# --- p2


def test_a_form_without_another_reading_is_read_as_it_is():
    got = pd.concat(variants._attribute([pd.DataFrame({"v": ["n. hue|"], "read": [None], "cost": [0.0], "c": ["nguyen hue|"], "m": [3]})]))
    assert got[["v", "c"]].values.tolist() == [["n. hue|", "nguyen hue|"]]


def test_texts_of_nodes_are_shuffled_once(spark):
    rows = spark.createDataFrame([("b", "Ai xây thành?", 1), ("a", "Ai  xây thành", 1), ("c", "Khi nào?", 2)], "key string, text string, rid long")
    nodes = questions.with_text(rows)
    assert nodes._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, nodes.collect())) == [(1, "Ai  xây thành"), (2, "Khi nào?")]


def test_signs_of_words_end_with_their_task():
    import gc
    import weakref

    counts = overlap.np.ones(overlap.CELLS, dtype="int32")
    signs = overlap.Signs(counts, counts > 0, 1, 0.5, False)
    list(signs.rows(["ai", "thanh"]))
    gone = weakref.ref(signs)
    gc.disable()
    try:
        del signs
        assert gone() is None
    finally:
        gc.enable()


def test_sample_meets_targets(spark):
    levels = ["nhan_biet"] * 400 + ["Thông hiểu"] * 300 + ["van_dung"] * 60 + ["van-dung-cao"] * 2
    rows = [(f"i{k}", b, "T", 0.5) for k, b in enumerate(levels)] + [("bad", "van_dung", "T", float("nan")), ("bad2", "van_dung", "T", 1.5), (None, "van_dung", "T", 0.5), ("nob", None, "T", 0.5)] + [("i0", "nhan_biet", "T", 0.5)]
    bank = spark.createDataFrame(rows, "item_id string, bloom string, title string, verifier_score double")
    bp = spark.createDataFrame([(1, 100, b, None, s, m) for b, s, m in (("nhan_biet", 0.4, 1), ("thong_hieu", 0.4, 1), ("van_dung", 0.155, 1), ("van_dung_cao", 0.045, 3))] + [(2, 10, "nhan_biet", "nope", 0.5, 1)], "blueprint_id int, sample_size int, bloom string, title string, target_share double, min_items int")
    got, report = sampling.sample(bank, bp)
    n = {r["bloom"]: r["count"] for r in got.groupBy("bloom").count().collect()}
    assert n["nhan_biet"] == 40 and n["thong_hieu"] == 40 and n["van_dung"] in (15, 16) and n["van_dung_cao"] == 2
    assert got.count() == got.select("item_id").distinct().count()
    rep = {(r["blueprint_id"], r["bloom"]): (r["available"], r["needed"], r["unmet"]) for r in report.collect()}
    assert rep[1, "van_dung_cao"] == (2, 5, True) and rep[1, "van_dung"] == (60, 16, False) and rep[2, "nhan_biet"] == (0, 5, True)
    again = sampling.sample(bank.repartition(7), bp)[0]
    assert {r["item_id"] for r in got.collect()} == {r["item_id"] for r in again.collect()}


# --- p3


def _passage(rng, n=120):
    return [rng.choice("vua dân thành sông núi chợ thuế muối gạo lính quan đền chùa làng".split()) + chr(97 + rng.randrange(26)) + chr(97 + rng.randrange(26)) for _ in range(n)]


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        w = _passage(rng)
        rows.append((f"t{i:03d}", " ".join(w), "train"))
        if i % 4 == 0:
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = "sửa"
            rows.append((f"e{i:03d}", " ".join(w).upper() + ".", rng.choice(["dev", " TEST", "val"])))
    rows += [("n1", None, "dev"), ("n2", "", "dev"), (None, rows[0][1], "dev"), ("n3", rows[0][1], None), ("z", " ".join(_passage(rng, 20000)), "test")]
    df = spark.createDataFrame(rows, "context_id string, context string, split string")
    got = {(r["a"], r["b"]) for r in leaks.overlaps(df, "context_id", "context", "passage").collect()}
    train = [r for r in rows if r[2] == "train"]
    held = [r for r in rows if r[0] and r[1] and r[2] and r[2] != "train" and r[0] != "z"]
    want = {(t[0], h[0]) for t in train for h in held if same.compare(t[1], h[1], leaks.LEAST)[0] >= leaks.LEAST}
    assert len(want) == 30 and got == want
    rep = leaks.report(leaks.overlaps(df, "context_id", "context", "passage"), df.withColumn("title", F.lit("T")), "context_id")
    assert sum(r["records"] for r in rep.collect()) == 30


def test_near_copies_in_a_family_of_a_third_of_the_passages(spark):
    rng = random.Random(8)
    base, short, rows = _passage(rng, 40), _passage(rng, 9), []
    for i in range(60):
        w = [f"mới{i}x{k}" if k % 4 == 0 else x for k, x in enumerate(base)]  # every fourth word: no run of five is left
        rows.append((f"f{i:03d}", " ".join(w), "train" if i % 3 else "test"))
    for i in range(6):
        rows.append((f"s{i}", " ".join([*short[:4], f"ngắn{i}", *short[5:]]), "train" if i % 2 else "dev"))
    rows += [(f"o{i:03d}", " ".join(_passage(rng, 40)), "train" if i % 3 else "dev") for i in range(120)]
    df = spark.createDataFrame(rows, "context_id string, context string, split string")
    got = {(r["a"], r["b"]) for r in leaks.overlaps(df, "context_id", "context", "passage").collect()}
    want = {(t[0], h[0]) for t in rows for h in rows if t[2] == "train" != h[2] and same.compare(t[1], h[1], leaks.LEAST)[0] >= leaks.LEAST}
    assert len(want) == 40 * 20 + 9 and got == want


@pytest.mark.parametrize("hot, block, small", [(1000, 4000, 1000), (2, 4000, 1000), (2, 9, 4), (1000, 7, 3)])
@pytest.mark.parametrize("both", [True, False])
def test_sharing_equals_brute_force(spark, monkeypatch, hot, block, small, both):
    monkeypatch.setattr(overlap, "HOT", hot)
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "SMALL", small)
    rng = random.Random(9)
    plain, names, rows = _passage(rng, 40), [f"Tên{i}q" for i in range(12)], []
    for i in range(40):
        w = ["khi", *rng.choices([*plain, *names], k=rng.randrange(1, 25))]
        for k in range(3):
            rows.append((3 * i + k - 60, " ".join(w), both or rng.random() < 0.7, both or rng.random() < 0.6))
            for _ in range(rng.randrange(5)):
                w[rng.randrange(1, len(w))] = rng.choice([*plain, *names, "lạ" + str(i)])
    df = spark.createDataFrame(rows, "rid long, text string, left boolean, right boolean")
    got = [(r["x"], r["y"]) for r in overlap.sharing(df, 0.66).collect()]

    def weight(words):
        return sum(4 if w.startswith("ten") else 1 for w in words)

    sets = {r[0]: set(fold_words(r[1])) for r in rows}
    want = {
        (a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[2] and b[3] or a[3] and b[2])
        and weight(sets[a[0]] & sets[b[0]]) >= 0.66 * max(weight(sets[a[0]]), weight(sets[b[0]])) - 1e-9
    }
    assert len(got) == len(set(got)) and len(want) > 20 and want <= set(got)
    if small > 100:
        assert want == set(got)


def test_sharing_of_long_texts_by_sample(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        w = _passage(rng, rng.randrange(30, 400))
        for k in range(2):
            rows.append((2 * i + k, " ".join(w), k == 0, k == 1))
            for _ in range(len(w) // 5):
                w[rng.randrange(len(w))] = f"mới{i}"
    df = spark.createDataFrame(rows, "rid long, text string, left boolean, right boolean")
    got = {(r["x"], r["y"]) for r in overlap.sharing(df, leaks.SHARE, sample=True).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(60)}


def _cell(word):
    return overlap.hash_of(word) % overlap.CELLS


def test_words_of_one_side_alone_are_shared_by_no_pair(spark):
    rows = [("ai xây chùa này", 1), ("ai dựng chùa kia", 1), ("ai xây thành", 2), ("ai phá thành", 2), ("ai giữ đền", 3), ("kẻ nào", 1)]
    counts, named = overlap.word_counts(spark.createDataFrame(rows, "text string, side int"))
    assert [int(counts[_cell(w)]) for w in ("ai", "xay", "chua", "thanh", "den", "ke")] == [5, 2, 1, 1, 1, 1]
    signs = overlap.Signs(counts, named, 6, 0.5, False)
    assert [len(keys) for keys, _ in signs.rows(fold_words("ai xây chùa này"))] == [1]  # what xay and ai, the last ones, may be missing
    assert [len(keys) for keys, _ in signs.rows(fold_words("kẻ nào"))] == [0]


def test_words_with_one_code_count_each(spark):
    by = {}
    for i in range(3000):
        w = f"chùa{i}x"
        by.setdefault(overlap.hash_of(fold_words(w)[0]) >> 48 & 0x7FFF, []).append(w)
    alike = [w[:2] for w in by.values() if len(w) > 1][:20]
    rows = [(2 * i + k, f"{a} {b} {other}", k == 0, k == 1) for i, (a, b) in enumerate(alike) for k, other in enumerate(("nào", "đâu"))]
    got = {(r["x"], r["y"]) for r in overlap.sharing(spark.createDataFrame(rows, "rid long, text string, left boolean, right boolean"), 0.66).collect()}
    assert len(alike) == 20 and got == {(2 * i, 2 * i + 1) for i in range(20)}


def _keys(own, start, slack, common, need, key, expected, most, depth, hot):
    """Keys of a text, word by word; own: place, count, weight."""
    for i in range(start, len(own)):
        if slack < 0:
            return
        place, count, weight = own[i]
        if count > 1:
            k = (key * 0x9E3779B97F4A7C15 ^ place) * 0xC2B2AE3D27D4EB4F % 2**64
            k ^= k >> 29
            e = min(count, expected / 2)
            if e <= hot or depth == overlap.DEPTH or common + weight >= need:
                yield k - (k >> 63 << 64), min(most, count)
            if e > hot and depth < overlap.DEPTH:
                yield from _keys(own, i + 1, slack, common + weight, need, k, e, min(most, count), depth + 1, hot)
        slack -= weight


@pytest.mark.parametrize("sample", [False, True])
def test_keys_of_many_texts_are_those_of_each(sample):
    rng = random.Random(13)
    plain = _passage(rng, 60) + ["12", "1954"]
    texts = [" ".join(rng.choices(plain, k=rng.choice([1, 2, 9, 50, 100]))) for _ in range(80)]
    counts = overlap.np.array([rng.choice([1, 2, 5, 40, 3000]) for _ in range(1 << 10)] * (overlap.CELLS >> 10), dtype="int32")
    signs = overlap.Signs(counts, counts % 2 == 1, 5000, 0.55, sample, 30)
    row, sizes, codes, whose, keys, most = signs.of(texts)
    ends = sizes.cumsum()
    assert set(row.tolist()) == set(range(80)) and (len(row) > 80) == sample and ends[-1] == len(codes)
    at, hashes, place, count, heavy, classes = signs._ordered(texts)
    for r in range(len(row)):
        a, b = int(ends[r] - sizes[r]), int(ends[r])
        own = list(zip(place[a:b].tolist(), count[a:b].tolist(), [4 if h else 1 for h in heavy[a:b]], strict=True))
        total = sum(o[2] for o in own)
        need = -(-(total * 55) // 100)
        want = sorted(_keys(own, 0, total - need, 0, need, int(classes[at[a]]) + 1, 10000.0, 5000, 1, 30))
        assert own == sorted(own) and want == sorted(zip(keys[whose == r].tolist(), most[whose == r].tolist(), strict=True))
        if not sample:
            assert b - a == len(set(fold_words(texts[row[r]])))


def test_names_of_many_texts_are_those_of_each():
    texts = ["Ai là vua? Vua Hùng ở Phú Thọ.", "AI XÂY THÀNH ĐẠI LA", "khi nào", "— Năm 1954: Điện Biên", "1. Hà Nội là đâu... Nội", "", "a B"]
    who, cell, told, named = overlap._word_cells(texts)
    words = {(i, _cell(w)) for i, t in enumerate(texts) for w in fold_words(t)}
    assert sorted(zip(who.tolist(), cell.tolist(), strict=True)) == sorted(words)
    assert {i for i, t in zip(who.tolist(), told, strict=True) if t} == {0, 3, 4, 6}
    got = {(i, c) for i, c, n in zip(who.tolist(), cell.tolist(), named, strict=True) if n}
    assert got == {(i, _cell(w)) for i, ws in {0: "hung phu tho", 3: "bien", 4: "noi", 6: "b"}.items() for w in ws.split()}


def test_texts_of_records_in_no_pair_are_not_shuffled(spark):
    rng = random.Random(17)
    rids = [rng.getrandbits(64) - 2**63 for _ in range(3000)]
    nodes = spark.createDataFrame([(r, str(r)) for r in rids], "rid long, text string")
    pairs = spark.createDataFrame(list(zip(rids[:50], rids[50:100], strict=True)), "x long, y long")
    got = [r["rid"] for r in questions.of_pairs(nodes, pairs).collect()]
    assert len(got) == len(set(got)) < 110 and set(rids[:100]) <= set(got)
    assert questions.of_pairs(nodes, pairs.where("false")).count() == 0


# --- p4


def test_pieces(spark, tmp_path):
    rng = random.Random(1)
    texts = {
        "short": "một câu.", "edge": "x" * 1500, "run": "y" * 5000, "empty": "", "lines": "\n\n".join(" ".join(_passage(rng, 60)) + "." for _ in range(40)),
        "long": " ".join(_passage(rng, 60_000)), "abbr": ("Theo TS. K. và GS. M. (tr. 12.000 v.v.), vua về. " * 60).strip(), "marks": unicodedata.normalize("NFD", "Đường về phía bắc. ") * 200,
        "accents": unicodedata.normalize("NFD", "é" * 2000), "odd": "x" + unicodedata.normalize("NFD", "é" * 2000),
    }
    df = spark.createDataFrame([*texts.items(), ("short", "một câu."), ("none", None), (None, "x")], "context_id string, context string")
    rows = {}
    for r in pieces.split_texts(df, "context_id", "context", overlap=120)[0].collect():
        rows.setdefault(r["id"], []).append(r)
    assert set(rows) == set(texts)
    for k, t in texts.items():
        p = sorted(rows[k], key=lambda r: r["piece_no"])
        assert all(len(r["piece"]) <= 1500 and r["piece"] == t[r["start"] : r["end"]] for r in p)
        assert p[0]["start"] == 0 and p[-1]["end"] == len(t)
        assert all(b["start"] == a["end"] - 120 for a, b in zip(p, p[1:]))
    assert len(rows["edge"]) == 1 and {r["cut"] for r in rows["run"]} == {"hard", "end"}
    assert {r["cut"] for r in rows["lines"]} <= {"paragraph", "end"}
    assert all(r["piece"].endswith("về. ") for r in rows["abbr"] if r["cut"] != "end")
    assert not any(unicodedata.combining(t[r["end"]]) for k, t in texts.items() for r in rows[k] if r["end"] < len(t))
    path = tmp_path / "big.txt"
    path.write_text(texts["long"] + "\n\n" + texts["lines"], encoding="utf-8")
    ranges = pieces.ranges_of_files(spark, [str(path)])
    got = pieces.emit_pieces(ranges, pieces.plan_pieces(ranges, overlap=120)).orderBy("piece_no").collect()
    whole = path.read_text(encoding="utf-8")
    assert [r["piece"] for r in got] == [whole[r["start"] : r["end"]] for r in got] and got[-1]["end"] == len(whole)


def test_boundaries_take_linear_time():
    began = time.perf_counter()
    for c in ["a", ".", " ", '"', ",", ". ", "e\u0301"]:
        pieces.boundaries(c * (65_536 // len(c)))
    assert time.perf_counter() - began < 2
    assert {o: k for o, k in pieces.boundaries("Ông TS. Minh nói. Rồi đi.").items() if k > 1} == {18: 3}


# --- p5


def test_kinds_of_answers():
    q = "Trong giai đoạn năm 1170, vai trò của Sưng Dốt Phùng Đuất trong tính toán của Goạch Thước là gì?"
    assert all(answers.is_empty(x) for x in (None, "", " ", "…", "N/A", "[chưa có đáp án]", "-"))
    assert not answers.is_empty("nă") and not answers.is_empty("1954")
    assert answers.is_copy(q, "Trả lời: " + q) and answers.is_copy(q, q.lower()[26:]) and not answers.is_copy(q, "Sưng Dốt Phùng Đuất")
    assert all(answers.is_refusal(x) for x in ("Rất tiếc, tôi không thể trả lời câu hỏi này.", "I'm sorry, but I can't answer that", "Désolé, je ne peux pas répondre à cette question.", "Mình chịu, không trả lời được đâu"))
    assert not any(map(answers.is_refusal, ("Không thể vượt sông trong im lặng", "Từ chối ký hòa ước và rút về bến đò")))
    assert answers.links("sau đó lan sang và") and not answers.links("ở miền thượng du") and answers.other_script(q, "因为粮食不足")


def test_defects(spark, data):
    good = [(f"g{i}", "Ai giữ kho muối ở bến đò?", t, None) for i, t in enumerate(["Do vua tăng thuế muối lên gấp 5 lần", "Vì thợ mỏ thiếu gạo trong trận dịch", "Không thể vượt sông trong im lặng"] * 8)]
    bad = [("b1", "Ai giữ kho muối ở bến đò?", "Do vua tăng thuế muối lên gấp", None), ("b2", "Ai giữ kho muối ở bến đò?", "Because the traders ran out of salt during the siege", None), ("b3", None, None, None), ("b4", "Ai?", "Vì thợ mỏ thi", None)]
    kind = "item_id string, question string, answer_text string, options array<struct<label string, text string, is_correct boolean, entity_type string, provenance string>>"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang")
    got = {r["item_id"]: r["defect"] for r in answers.defects(spark.createDataFrame(good + bad + bad[:1], kind), docs).collect()}
    assert got == {"b1": "truncated_answer", "b2": "other_language", "b3": "empty_answer", "b4": "truncated_answer"}


# --- p6


def test_groups_stay_together(spark):
    c = spark.createDataFrame([("A", "c1", "train"), ("a ", "c2", "dev"), ("B", "c3", "train"), ("C", "c4", "test"), (None, "c5", "train"), ("D", "c6", "training"), ("D", "c7", "TRAIN"), ("E", "c8", None)], "title string, context_id string, split string")
    q = spark.createDataFrame([("B", "c4", "test"), ("X", "c5", "train"), ("E", "c8", "test"), ("A", None, "test")], "title string, context_id string, split string")
    plan, broken = splitting.keep_together(c, q)
    assert {r["context_id"] for r in broken.collect()} == {"c1", "c2", "c3", "c4"}
    by = {r["context_id"]: (r["group"], r["new_split"]) for r in plan.collect()}
    assert by["c1"] == by["c2"] and by["c3"] == by["c4"] and by["c6"] == by["c7"] and len(by) == 8


def test_assignment_meets_proportions(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"g{i}", rng.randrange(1, 40)) for i in range(500)] + [("hot", 1500)], "group string, rows long")
    got = splitting.assign(df).collect()
    total = sum(r["size"] for r in got)
    assert len(got) == 501
    for s, p in splitting.PROPORTIONS.items():
        assert abs(sum(r["size"] for r in got if r["new_split"] == s) / total - p) < 0.02
    assert splitting.assign(df.limit(0)).count() == 0


def test_assignment_of_many_groups_equals_the_plain_fold(spark):
    rng = random.Random(3)
    sizes = {f"g{i:05d}": rng.choice([1, 1, 1, 2, 3, 3, 7, 50]) for i in range(25_000)}
    below = {s: Fraction(str(p)) * sum(sizes.values()) for s, p in splitting.PROPORTIONS.items()}
    want: Counter = Counter()
    for n in sorted(sizes.values(), reverse=True):
        s = max(below, key=below.get)
        below[s] -= n
        want[n, s] += 1
    got = splitting.assign(spark.createDataFrame(list(sizes.items()), "group string, rows long"))
    assert {(r["size"], r["new_split"]): r["count"] for r in got.groupBy("size", "new_split").count().collect()} == dict(want)
    assert {r["group"]: r["size"] for r in got.collect()} == sizes


# --- p7


def test_divide_skip_equals_counting():
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        lists = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 40))), dtype=np.int64) for _ in range(rng.randrange(1, 9))]
        w = np.array([rng.random() + 0.1 for _ in lists])
        need = rng.random() * w.sum()
        want = [i for i in range(60) if sum(x for x, li in zip(w, lists, strict=True) if i in li) >= need - 1e-9 and any(i in li for li in lists)]
        assert overlap.divide_skip(lists, w, need).tolist() == want


def test_question_groups(spark):
    base = "Sau khi mất nguồn ngọc trai, Xưởng Đóng Thuyền Drixfas Stannaex bắt đầu dựng kho hạt tiêu tại Drashord Zeirles vào năm bao nhiêu?"
    other = "Dưới áp lực của nông dân, Vóc Dình Điêng Xuyển gặp Quuềnh Gênh Sẫm Xiếp vào thời gian nào?"
    rows = [("a", base), ("b", base.lower().replace("?", "")), ("c", "[Ôn tập] " + base.replace("bắt đầu", "khởi sự")), ("d", base.replace("Drixfas Stannaex", "Heixgrax Norzel")), ("e", other), ("f", other.replace("gặp", "đã gặp rốt cuộc")), ("g", None), ("h", "?"), ("a", base)]
    df = spark.createDataFrame(rows, "item_id string, question string")
    members, _ = questions.groups(df)
    assert {(r["a"], r["b"]) for r in questions.pairs(members).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("e", "f")}


def test_questions_of_a_hot_family_with_rare_words_changed(spark):
    rng = random.Random(5)
    base = "vì sao người dân ở vùng này phải nộp thêm thuế muối cho quan khi mùa nước lên vậy".split()
    rows = [(f"f{i:03d}", " ".join(f"lạ{i}q{k}" if k in (1, 5, 9, 13, 17) else w for k, w in enumerate(base))) for i in range(40)]
    rows += [(f"o{i:03d}", " ".join(_passage(rng, 19))) for i in range(80)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "rid long, text string").selectExpr("*", "true as left", "true as right")
    got = {frozenset((rows[r["x"]][0], rows[r["y"]][0])) for r in questions.same_pairs(df).collect()}
    want = {frozenset((a[0], b[0])) for a in rows[:40] for b in rows[:40] if a[0] < b[0] and same.same_question(a[1], b[1])}
    assert len(want) == 40 * 39 // 2 and got == want


# --- p8


def test_ids_equal_tiktoken():
    import regex
    import tiktoken

    ranks = tokenize.load_ranks("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert ranks == tokenize.load_ranks(tokenize.VOCABULARY)
    ref = tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    t, split = tokenize.Transducer(ranks, most=3000), regex.compile(tokenize.PATTERN).findall
    rng = random.Random(0)
    parts = ["a", "tion", " the", "th", " ", "\n", "0", "é", "ế", "—", "😀", "‍", "aaaa", "=", "--", "\t", "<|endoftext|>", "'s", " \n ", "ư", "ờ"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        ids = t.encode(s, split)
        assert ids == ref.encode_ordinary(s)
        u = tokenize.Utf8()
        assert "".join(u.feed(t.bytes[i]) for i in ids) + u.close() == s
    for s in ("*" * 20_001, "ế" * 9999, " " * 5000):
        assert t.encode(s, split) == ref.encode_ordinary(s)


def test_encode_edges(spark):
    df = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (3, "Huế", "n"), (3, "Huế", "n")], "doc_id int, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode(df).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) > 0 and tokenize.encode(df).count() == 3
    assert {r["doc_id"]: r["text"] for r in tokenize.decode(tokenize.encode(df)).collect()} == {1: "", 2: "", 3: "Huế"}


# --- p9


def test_short_parts_are_found():
    words = "vua ban chiếu dời đô về thành mới năm ấy rồi mất".split()
    for n in range(2, 13):
        got = contamination.Scanner([("i", " ".join(words[:n]))]).scan("trước đó " + " ".join(words[:n]) + " sau đó")
        assert got == [("i", 9, 9 + len(" ".join(words[:n])))], n
    for n in range(9, 13):
        text = " ".join([*words[:5], "khác", *words[6:n]])
        assert contamination.Scanner([("i", " ".join(words[:n]))]).scan("trước đó " + text + " sau đó"), n


def test_stems_that_many_items_share(spark, monkeypatch):
    rng = random.Random(10)
    stem = " ".join(_passage(rng, 40))
    items = spark.createDataFrame([(f"q{i}", f"Câu {i}:\n{stem}?\nA. x\nB. y", None) for i in range(9)], "id string, question string, explanation string")
    docs = spark.createDataFrame([(1, "Trước đó. " + " ".join(stem.split()[5:38]) + " hết"), (2, " ".join(stem.split()[:10]))], "doc_id long, text string")
    want = {(1, f"q{i}") for i in range(9)}
    assert {(r["doc_id"], r["id"]) for r in contamination.leaks(docs, items).collect()} == want
    monkeypatch.setattr(contamination, "MOST_WORDS", 100)  # several automata
    assert {(r["doc_id"], r["id"]) for r in contamination.leaks(docs, items).collect()} == want


def test_leaks_and_offsets(spark):
    rng = random.Random(9)
    stem = " ".join(_passage(rng, 50))
    why = " ".join(_passage(rng, 60))
    items = spark.createDataFrame([("q1", f"Câu 7:\n{stem}?\nA. x\nB. y", f"{why}.\nChọn A."), ("q2", None, None), (None, stem, why)], "id string, question string, explanation string")
    w = stem.split()
    changed = [*w[:12], "khác", *w[13:20], "(chú thích chen ngang)", *w[20:35]]
    docs = [
        (1, "Mở đầu dài. " + stem.upper() + " Hết."), (2, "Nói qua: " + " ".join(w[:8]) + " rồi thôi."), (3, " ".join(_passage(rng, 300))), (4, "x " + "\n".join(changed) + " y"),
        (5, unicodedata.normalize("NFD", " ".join(why.split()[10:45]))), (6, None), (7, ""), (8, " ".join(why.split()[:20])),
    ]
    got = {(r["doc_id"], r["id"]): (r["start"], r["end"]) for r in contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, "q1"), (4, "q1"), (5, "q1")}
    a, b = got[1, "q1"]
    assert fold_words(docs[0][1][a:b]) == fold_words(stem)


# --- p10


def test_kinds_on_held_out_sample(spark, data):
    got = quality.kinds(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    n = {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()}
    assert set(n) == set(quality.KINDS) and n["prose"] > 0.7 * sum(n.values())
    assert got.where("abs(p_prose + p_list + p_table + p_junk - 1) > 1e-9").count() == 0
    s = dict(zip(quality.STATISTICS, quality.statistics("Vua về. Dân vui!"), strict=True))
    assert s["n_words"] == 4 and s["n_lines"] == 1 and s["lines_ending_in_punctuation"] == 1 and s["mean_word_length"] == 2.75


def test_sample_is_bounded_and_calibrated(spark, data):
    from tramsu.llm.holdout import CHECKED

    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = quality.sample_statistics(docs, 100)
    assert 60 < len(got) <= 100 and got["doc_id"].is_unique
    many = docs.limit(1).crossJoin(spark.range(500).select(F.lit(0).alias("again")))  # one id, delivered again and again
    assert len(quality.sample_statistics(many, 100)) <= 1
    found = quality.calibration(quality.fit(docs), CHECKED)
    assert found["accuracy"] > 0.85 and found["error"] < 0.2, found


def test_kinds_of_edges(spark):
    from tramsu.llm.holdout import CHECKED

    rows = [(i, t) for i, (_, t) in enumerate(CHECKED)] + [(900, None), (901, ""), (902, " \n​"), (903, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = {r["doc_id"]: r["kind"] for r in quality.kinds(docs, model).collect()}
    assert not {900, 901, 902} & set(got) and got[903] == "junk"
    assert sum(got[i] == k for i, (k, _) in enumerate(CHECKED)) >= len(CHECKED) - 1

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from flowgauge import cli
from flowgauge.functions import keywords
from flowgauge.operators import matching, relations
from flowgauge.plans.compare import compare
from flowgauge.plans.evaluate import SENSITIVITY, Options, evaluate, result_document
from flowgauge.sources import images, predictions, sinks
from flowgauge.streaming import rescore
from tests import plain

DOC = "doc_id string, entities array<struct<id: string, type: string, text: string>>, relations array<struct<source: string, target: string, type: string, label: string>>"
ent = lambda i, t, x: {"id": i, "type": t, "text": x}
rel = lambda s, t: {"source": s, "target": t, "type": "isPreceededBy"}
GOLD = {
    "entities": [ent("G1", "Action", "Vervang filter"), ent("G2", "Decision", "Past deze klep op alle leidingen?"), ent("G3", "Condition", "Ja"), ent("G4", "Action", "Bekijk watermeter")],
    "relations": [rel("G2", "G1")],
}
PAGE1 = {
    "entities": [ent("E1", "Action", "0) Vervang filter"), ent("E2", "Decision", "Past deze klep op alle leidinge?"), ent("E3", "Condition", "ja ")],
    "relations": [rel("E2", "E1"), rel("E2", "E1")],
}
PAGE2 = {"entities": [ent("E1", "Action", "Bekijk de watermeter")], "relations": []}


def docs(spark, graphs):
    rows = [(k, [(e.get("id"), e.get("type"), e.get("text")) for e in g["entities"]], [(r["source"], r["target"], r["type"], None) for r in g["relations"]]) for k, g in graphs.items()]
    return spark.createDataFrame(rows, DOC)


def counts(scores):
    return {(r.threshold, r.doc_id, r.target): (r.tp, r.fp, r.fn) for r in scores.per_doc.collect()}


def test_worked_document(spark):
    scores = evaluate(docs(spark, {"d": PAGE1}), docs(spark, {"d": GOLD}))
    rows = {r.target: r for r in scores.per_doc.collect()}
    e, r = rows["entities"], rows["relations"]
    assert (e.tp, e.fp, e.fn, e.precision, e.recall) == (3, 0, 1, 1.0, 0.75)
    assert e.f1 == pytest.approx(6 / 7)
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (2, 0, -1, 1.0, 2.0)
    assert r.f1 == pytest.approx(4 / 3)
    assert {(m.pred_id, m.gt_id, m.method, m.score) for m in scores.accepted.collect()} == {("E1", "G1", "exact_match", 1.0), ("E3", "G3", "exact_match_short", 1.0), ("E2", "G2", "substring_match", 0.96875)}
    once = evaluate(docs(spark, {"d": PAGE1}), docs(spark, {"d": GOLD}), Options(dedup_predictions=True))
    assert counts(once)[0.7, "d", "relations"] == (1, 0, 0)


def paged(spark, pages):
    value = json.dumps([{"page": k + 1, "raw": None, "json": g} for k, g in enumerate(pages)])
    return spark.createDataFrame([("d", value)], "file string, value string")


@pytest.mark.parametrize(("own", "want"), [(False, (0, 2, 1)), (True, (2, 0, -1))])
def test_ids_collide_across_pages(spark, own, want):
    pred = predictions.parsed_outputs(paged(spark, [PAGE1, None, PAGE2]), namespace_ids=own).withColumnRenamed("file", "doc_id")
    got = counts(evaluate(pred, docs(spark, {"d": GOLD})))
    assert got[0.7, "d", "entities"] == (4, 0, 0)
    assert got[0.7, "d", "relations"] == want


def test_either_direction(spark):
    turned = GOLD | {"relations": [rel("G1", "G2")]}
    assert counts(evaluate(docs(spark, {"d": PAGE1}), docs(spark, {"d": turned})))[0.7, "d", "relations"][0] == 0
    assert counts(evaluate(docs(spark, {"d": PAGE1}), docs(spark, {"d": turned}), Options(direction="either")))[0.7, "d", "relations"][0] == 2


def test_ties_empty_and_missing(spark):
    none = {"entities": [], "relations": []}
    twins = {"entities": [ent("a", "Action", "gelijk"), ent("b", "Action", "gelijk")], "relations": []}
    blank = {"entities": [ent("", None, None), ent(None, None, "")], "relations": []}
    scores = evaluate(docs(spark, {"t": twins, "none": none, "both": none, "blank": blank, "only": twins}), docs(spark, {"t": twins, "none": GOLD, "both": none, "blank": blank}))
    got = counts(scores)
    assert got[0.7, "none", "entities"] == (0, 0, 4)
    assert got[0.7, "both", "entities"] == (0, 0, 0)
    assert got[0.7, "blank", "entities"] == (2, 0, 0)
    assert (0.7, "only", "entities") not in got
    assert {(m.pred_idx, m.gt_idx) for m in scores.accepted.where("doc_id = 't'").collect()} == {(0, 0), (1, 1)}
    assert all(r.f1 == 0 for r in scores.per_doc.where("doc_id = 'both'").collect())


WORDS = ["klep", "buis", "vast", "de", "vervang", "filter", "ja", "nee", "water meter", "bekijk"]


def random_graph(rng, n):
    ents = [ent(f"E{rng.randrange(n)}", rng.choice(["Action", "Decision", None]), " ".join(rng.choices(WORDS, k=rng.randrange(5)))) for _ in range(rng.randrange(n + 1))]
    ids = [e["id"] for e in ents] + ["E99"]
    return {"entities": ents, "relations": [rel(rng.choice(ids), rng.choice(ids)) for _ in range(rng.randrange(n + 1))]}


def test_random_documents_as_plain(spark):
    rng = random.Random(5)
    pred = {f"d{k}": random_graph(rng, 9) for k in range(40)}
    gold = {k: random_graph(rng, 9) for k in pred}
    words = lambda t: {w for w in t.lower().split() if len(w) > 2 and w not in keywords.STOP}
    for memo in (False, True):
        scores = evaluate(docs(spark, pred), docs(spark, gold), Options(SENSITIVITY, keywords.token_keywords, memo=memo))
        got = counts(scores)
        methods = {(r.threshold, r.method): r.n for r in scores.methods().collect()}
        total = {}
        for t in SENSITIVITY:
            for k in pred:
                e, r, how = plain.score(pred[k], gold[k], t, words)
                assert (got[t, k, "entities"], got[t, k, "relations"]) == (e, r), (t, k)
                for m, n in how.items():
                    total[t, m] = total.get((t, m), 0) + n
        assert methods == total


def test_greedy_as_plain(spark):
    """Ranks and positions of the assignment, with native features, too."""
    rng = random.Random(6)
    pred, gold = ({k: random_graph(rng, 30) for k in "ab"} for _ in range(2))
    p, g = (matching.entity_rows(docs(spark, x)) for x in (pred, gold))
    got = {}
    for native in (False, True):
        rows = matching.matches_at(matching.candidate_pairs(p, g, 0.6, native=native), [0.6, 0.9])
        got[native] = sorted((r.threshold, r.doc_id, r["rank"], r.pred_idx, r.gt_idx, r.method) for r in matching.greedy_match(rows).collect())
    want = [(t, k, n + 1, i, j, how) for t in (0.6, 0.9) for k in "ab" for n, (i, j, _, how) in enumerate(plain.assign(pred[k]["entities"], gold[k]["entities"], t)[0])]
    assert got[False] == got[True] == sorted(want) != []


def test_greedy_by_text_as_pairs(spark):
    """The same rows as from all pairs, with ties between texts, missing types and further keys."""
    rng = random.Random(8)
    pred, gold = ({k: random_graph(rng, 40) for k in "abc"} for _ in range(2))
    p, g = (matching.entity_rows(docs(spark, x)).withColumn("v", F.lit("x")) for x in (pred, gold))
    keys = ["doc_id", "v"]
    for memo in (False, True):
        known = matching.text_pairs(p, g, 0.6, keys, keywords.token_keywords, memo)
        pairs = matching.matches(p, g, known, [0.6, 0.9], keys)
        cols = ["threshold", *keys, "rank", "pred_idx", "gt_idx", "pred_id", "gt_id", "score", "method"]
        got, want = (sorted(map(tuple, x.select(*cols).collect())) for x in (matching.greedy_by_text(p, g, known, [0.6, 0.9], keys), matching.greedy_match(pairs, keys)))
        assert got == want != []


def test_greedy_makes_no_pairs(spark):
    """Of 40,000 entities with two texts no 10^8 pairs are made: that took minutes."""
    row = lambda side: spark.range(40000).selectExpr("'d' AS doc_id", "'A' AS type", "cast(id AS int) AS idx", f"concat('{side}', id) AS id", "if(id % 2 = 0, 'filter plaatsen', 'filter plaatsten') AS text")
    p, g = row("p"), row("g")
    start = time.monotonic()
    got = matching.greedy_by_text(p, g, matching.text_pairs(p, g, 0.7, memo=True), [0.7])
    assert got.where("pred_idx = gt_idx and rank = pred_idx + 1").count() == 40000
    assert time.monotonic() - start < 60


def test_texts_are_not_broadcast(spark):
    """A small file may hold many texts, which fill the driver when broadcast."""
    rows = spark.range(6).selectExpr("concat('d', id % 2) AS doc_id", "concat('A', id % 2) AS type", "cast(id AS int) AS idx", "string(id) AS id", "concat('klep ', id) AS text")
    taken = matching.greedy_by_text(rows, rows, matching.text_pairs(rows, rows, 0.7), [0.7])
    assert "BroadcastExchange" not in taken._jdf.queryExecution().executedPlan().toString()


def test_orders_as_listed_edges(spark):
    """Hits and numbers of edges that orders stand for, as of the same edges listed; ends map many to one, too."""
    rng = random.Random(9)
    sides = [[(d, rng.choice("xyz"), k, f"{side}{k}", rng.randrange(3)) for d in "ab" for k in rng.sample(range(90), 30)] for side in "pg"]
    pred, gold = (spark.createDataFrame(x, "doc_id string, block string, position long, id string, times int") for x in sides)
    maps = [(t, p[0], p[3], rng.choice([g[3] for g in sides[1] if g[0] == p[0]])) for t in (0.6, 0.9) for p in sides[0] if rng.random() < 0.8]
    ends = spark.createDataFrame([*maps, (0.6, "a", "p1", None)], "threshold double, doc_id string, pred_id string, gt_id string")

    def listed(order):
        later = order.selectExpr("doc_id", "block", "position AS l", "id AS source", "explode(array_repeat(1, times)) AS _")
        return later.join(order.selectExpr("doc_id", "block", "position AS e", "id AS target"), ["doc_id", "block"]).where("l > e").selectExpr("doc_id", "source", "target", "'x' AS type")

    got = sorted(map(tuple, relations.order_hits(pred, gold, ends).collect()))
    want = relations.relation_hits(listed(pred), listed(gold.withColumn("times", F.lit(1))), ends)
    assert got == sorted(map(tuple, want.collect())) != []
    assert sorted(map(tuple, relations.order_sizes(pred).collect())) == sorted(map(tuple, listed(pred).groupBy("doc_id").count().collect()))


def test_orders_make_no_edges(spark):
    """100,000 members stand for 5 * 10^9 edges, all of them hits."""
    pred = spark.range(100000).selectExpr("'d' AS doc_id", "'x' AS block", "id AS position", "string(id) AS id", "1 AS times")
    ends = pred.selectExpr("0.7D AS threshold", "doc_id", "id AS pred_id", "id AS gt_id")
    assert relations.order_hits(pred, pred, ends).collect() == [(0.7, "d", 100000 * 99999 // 2)]
    assert relations.order_sizes(pred).collect() == [("d", 100000 * 99999 // 2)]


def test_perfect_and_empty_tables(spark):
    same = evaluate(docs(spark, {"d": GOLD}), docs(spark, {"d": GOLD}))
    assert all(r.f1 == 1.0 for r in same.per_doc.collect())
    empty = docs(spark, {"d": GOLD}).limit(0)
    assert evaluate(empty, empty).per_doc.count() == 0


@pytest.fixture
def folders(tmp_path):
    gold, out = tmp_path / "gold", tmp_path / "out"
    gold.mkdir()
    out.mkdir()
    for name in ("a.json", "b.json", "c.json", "gone.json", "x.JSON"):
        (gold / name).write_text(json.dumps(GOLD))
    (out / "a.json").write_text(json.dumps([{"page": 1, "raw": "", "json": PAGE1}, {"page": 2, "raw": None, "json": None, "error": "e"}]))
    (out / "DP17-B.JSON").write_text(json.dumps(PAGE1))
    (out / "DP17-b.json").write_text(json.dumps(PAGE2))
    (out / "DP17-c.json").write_text("\n " + json.dumps(PAGE1 | {"note": 1}))
    (out / "DP17-GONE.json").write_text(json.dumps(GOLD))
    return str(gold), str(out)


def test_files(spark, folders):
    gold, out = predictions.read_gold(spark, folders[0]), predictions.read_outputs(spark, folders[1])
    assert {r.file: r.output for r in predictions.find_outputs(gold, out).collect()} == {"a.json": "a.json", "b.json": "DP17-B.JSON", "c.json": "DP17-c.json"}
    assert [r.file for r in predictions.missing_outputs(gold, out).collect()] == ["gone.json"]
    got = counts(evaluate(*predictions.paired_docs(gold, out)))
    assert {k[1]: v for k, v in got.items() if k[2] == "entities"} == dict.fromkeys(("a.json", "b.json", "c.json"), (3, 0, 1))


def test_command_line(spark, folders, tmp_path, capsys):
    cli.main(["evaluate", "--ground_truth", folders[0], "--model_output", folders[1], "--output", str(tmp_path / "r"), "--model_name", "m", "--sensitivity"])
    said = capsys.readouterr().out
    assert "no model output for gone.json" in said and "Entities: P=1.00, R=0.75, F1=0.86" in said
    r = sinks.read_result(spark, str(tmp_path / "r")).first()
    assert r.model_name == "m" and sorted(r.results) == ["0.6", "0.7", "0.8", "0.9"]
    at = r.results["0.7"]
    assert at.aggregate.entities.tp == 9 and [f.file for f in at.per_file] == ["a.json", "b.json", "c.json"]
    assert at.match_stats == {"exact_match": 3, "exact_match_short": 3, "substring_match": 3}
    cli.main(["compare", "--ground_truth", folders[0], "--enhanced", folders[0], "--standard", folders[1], "--output_dir", str(tmp_path)])
    said = capsys.readouterr().out
    assert "enhanced entity F1: 1.0000" in said and "Improvement: 0.1429" in said


def test_compare(spark):
    pred = docs(spark, {"d": GOLD}).withColumn("variant", F.lit("enhanced")).unionByName(docs(spark, {"d": PAGE1}).withColumn("variant", F.lit("standard")))
    r = compare(pred, docs(spark, {"d": GOLD})).first()
    assert r.enhanced.entities.f1 == 1.0 and r.improvement.entities_f1 == pytest.approx(1 / 7)


def test_streaming(spark, folders, tmp_path):
    gold = predictions.read_gold(spark, folders[0]).withColumnRenamed("file", "doc_id")
    out, mark = str(tmp_path / "counts"), str(tmp_path / "mark")
    rescore.rescore(spark, folders[0], gold, out, mark).awaitTermination()
    assert {r.target: r.f1 for r in rescore.totals(spark, out).collect()} == {"entities": 1.0, "relations": 1.0}
    (tmp_path / "gold" / "late.json").write_text(json.dumps(PAGE1))
    late = gold.unionByName(gold.where("doc_id = 'a.json'").withColumn("doc_id", F.lit("late.json")))
    rescore.rescore(spark, folders[0], late, out, mark).awaitTermination()
    assert {r.target: r.tp for r in rescore.totals(spark, out).collect()}["entities"] == 4 * 4 + 3


def test_images_and_documents(spark, tmp_path):
    pics, out = tmp_path / "pics", str(tmp_path / "docs")
    pics.mkdir()
    for name, body in (("d_page_2.png", b"two"), ("d_page_01.png", b"one"), ("d_page_3.png", b"bad"), ("cover.png", b"x"), ("d_page_4.jpg", b"x")):
        (pics / name).write_bytes(body)

    def make():
        def model(content, prompt):
            if content == b"bad":
                raise ValueError("unreadable")
            return json.dumps({"entities": [ent("E1", "Action", content.decode())], "relations": []})

        return model

    from flowgauge.functions.recover import recovered_pages

    pages = recovered_pages(images.extract(images.read_images(spark, str(pics)), make, images.PROMPTS["standard"], 2))
    rows = pages.orderBy("page").collect()
    assert [r.page for r in rows] == [1, 2, 3]
    assert rows[0].json.entities[0].text == "one"
    assert rows[2].raw is None and rows[2].error == "unreadable" and "ValueError" in rows[2].traceback
    assert sinks.write_documents(pages, f"file://{out}") == 1
    value = json.loads((tmp_path / "docs" / "d.json").read_text())
    assert [p["page"] for p in value] == [1, 2, 3] and value[1]["json"]["entities"][0]["text"] == "two"
    assert value[1]["n_entities"] == 1 and "n_entities" not in value[2]
    back = predictions.read_outputs(spark, out).first()
    assert (back.file, [e.text for e in back.entities]) == ("d.json", ["one", "two"])
    with pytest.raises(Exception, match="no file name"):
        sinks.write_files(spark.createDataFrame([("a/b", "")], "name string, value string"), f"file://{out}")


def test_a_worker_makes_a_model_once(spark, tmp_path):
    pages = spark.range(40).selectExpr("cast(id as string) as doc_id", "1 as page", "cast('x' as binary) as content").repartition(10)
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda content, prompt: str(os.getpid())

    pids = {r.raw for r in images.extract(pages, make, "p").collect()}
    made = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert set(made) >= pids and len(made) == len(set(made)) <= 8

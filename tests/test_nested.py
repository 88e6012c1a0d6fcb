"""JSON objects read by byte ranges of every size against json.loads."""

import json
import random

import pytest

from spanloom.sources import nested, qa

TRICKY = ['plain', 'a } b', '{"x": [1]}', 'quote " end', 'back\\', 'back\\\\" }', '"data": [', '}', '}}', '[[', ']]', '\\"}', 'é 中 𝄞 }', '"', '\\', '']


def article(draw, i):
    text = lambda: " ".join(draw.choice(TRICKY) for _ in range(draw.randrange(6)))
    answers = [{"text": text(), "answer_start": i} for _ in range(draw.randrange(3))]
    return {"title": text(), "paragraphs": [{"context": text(), "qas": [{"question": text(), "id": {"data": [{}, [text()]]}, "answers": answers}]} for _ in range(draw.randrange(3))]}


def expected(objects):
    return sorted(
        (p["context"], q["question"], a["text"], a["answer_start"])
        for o in objects
        for d in o.get("data", [])
        for p in d["paragraphs"]
        for q in p["qas"]
        for a in q["answers"]
    )


@pytest.fixture
def ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)

    yield use
    for n, v in kept.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size, indent", [(64, None), (97, 1), (1000, 2), (10**7, None)])
def test_every_cut(spark, tmp_path, ranges, size, indent):
    draw = random.Random(size)
    extra = lambda: {"meta": {"data": [{"paragraphs": [{"context": "no"}]}], "s": '}"data": ['}, "list": [[{"x": "}"}], {}]}
    objects = []
    for k in range(3):
        o = {"version": '1.1 "}', "data": [article(draw, i) for i in range(14)]}
        objects.append([{**extra(), **o}, {**o, **extra()}, {"data": []}][k])
    for k, o in enumerate(objects):
        (tmp_path / f"f{k}.json").write_text(json.dumps(o, indent=indent, ensure_ascii=k == 0) + "\n" * k)
    # several objects in a file, one of them without the key
    (tmp_path / "f3.json").write_text("\n".join(json.dumps(o) for o in [objects[0], {"other": [{}]}, {"data": [article(draw, 99)]}]))
    objects += [objects[0], {"data": json.loads((tmp_path / "f3.json").read_text().split("\n")[2])["data"]}]
    ranges(size)
    found = qa.read_squad_json(spark, str(tmp_path), multi_line=True)
    assert sorted(map(tuple, found.collect())) == expected(objects)
    elements = nested.read_elements(spark, str(tmp_path / "f0.json"), "data", qa.ARTICLE)
    rows = elements.orderBy("block", "at").collect()
    assert [len(r.element.paragraphs) for r in rows] == [len(a["paragraphs"]) for a in objects[0]["data"]]
    if size < 1000:
        assert len({r.block for r in rows}) > 3, "several ranges hold elements"


def test_the_table_is_read_by_several_tasks(spark, tmp_path, ranges):
    body = {"data": [{"paragraphs": [{"context": f"c{i}", "qas": [{"question": "q", "answers": [{"text": "t", "answer_start": i}]}]}]} for i in range(4000)]}
    (tmp_path / "one.json").write_text(json.dumps(body, indent=1))
    ranges(50_000)
    found = qa.read_squad_json(spark, str(tmp_path / "one.json"), multi_line=True)
    assert found.count() == 4000 and found.selectExpr("sum(answer_start)").first()[0] == 4000 * 3999 // 2
    rows = nested.read_elements(spark, str(tmp_path / "one.json"), "data", qa.ARTICLE)
    assert rows.select("block").distinct().count() > 10


def test_odd_files(spark, tmp_path):
    for name, body in {"empty": "", "space": " \n", "none": '{"x": 1}', "null": '{"data": [null, 3, {"paragraphs": null}, "s}"]}', "bad": '{"data": [{"paragraphs": [}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
    assert qa.read_squad_json(spark, str(tmp_path), multi_line=True).collect() == []


def test_files_of_the_check_follow_the_documents(spark, sf, monkeypatch):
    from checks import queries, tables

    monkeypatch.setattr(tables, "stored", lambda spark, d, s, name: f"{tables.shared_folder(spark)}/spanloom-checks/{name}-small")
    want = sorted(map(tuple, queries.read_squad_json(spark, sf).collect()))
    monkeypatch.setattr(tables, "JSON_FILE", 20_000)
    assert len(spark.read.text(tables.whole_json(spark, sf)).select("part").distinct().collect()) > 20
    assert sorted(map(tuple, queries.read_squad_json_whole(spark, sf).collect())) == want

"""From staged files to a store."""

import json
import random
import re

import pytest

from lexmill.operators import dedupe, extract, load, parse_html
from lexmill.schema import KEYS, REFERENCES, STORE_VARIABLE, ConstraintError, Store, judged, lacking, orphans, rejected, repeated, versions
from lexmill.sources import json_files, seed


def test_build(spark, tmp_path):
    staged = tmp_path / "seed"
    staged.mkdir()
    content = "Implements nothing but Article 6 of Regulation (EU) 2016/679 and Directive 95/46/EC and Regulation (EC) No 883/2004."
    docs = {
        "a.json": {"id": "act-a", "title": "Act A", "provisions": [{"provision_ref": "s1 ", "section": "1", "content": "short"}, {"provision_ref": "s2", "section": "2", "content": content}, {"provision_ref": "s1", "section": "1–", "content": "a longer one"}], "definitions": [{"term": "x", "definition": "first"}, {"term": "x", "definition": "second"}]},
        "b.json": {"id": "act-b", "title": "Act B", "status": "repealed", "provisions": [], "definitions": []},
        "_skip.json": {"id": "no", "title": "No"},
        ".hidden.json": {"id": "no", "title": "No"},
    }
    for name, doc in docs.items():
        (staged / name).write_text(json.dumps(doc, ensure_ascii=False, indent=2))
    mapping = 2 * [{"hungarian_document_id": i, "eu_document_id": "directive:2022/2555", "eu_type": "directive", "eu_year": 2022, "eu_number": 2555, "eu_community": "EU", "eu_title": "NIS2", "eu_short_name": "NIS2", "reference_type": "implements", "is_primary": True, "implementation_status": "complete"} for i in ("act-a",)] + [{"hungarian_document_id": "unknown", "eu_document_id": "directive:2022/2555", "eu_type": "directive", "eu_year": 2022, "eu_number": 2555, "eu_community": "EU", "reference_type": "implements"}]
    (tmp_path / "map.json").write_text(json.dumps(mapping))
    store = load.build(spark, seed.read_seed(spark, str(staged)), seed.read_mappings(spark, str(tmp_path / "map.json")), "2026-01-01T00:00:00Z", str(tmp_path / "db"))
    assert {(r["id"], r["type"], r["status"]) for r in store["legal_documents"].collect()} == {("act-a", "statute", "in_force"), ("act-b", "statute", "repealed")}
    rows = store["legal_provisions"].orderBy("id").collect()
    assert [(r["id"], r["provision_ref"], r["content"]) for r in rows] == [(1, "s1", "a longer one"), (2, "s2", content)]
    assert [r["definition"] for r in store["definitions"].collect()] == ["first"]
    edges = {(r["source_type"], r["eu_document_id"], r["eu_article"]) for r in store["eu_references"].collect()}
    assert edges == {("provision", "regulation:2016/679", "6"), ("provision", "directive:1995/46", "6"), ("document", "directive:2022/2555", None)}
    assert {r["id"] for r in store["eu_documents"].collect()} == {"regulation:2016/679", "directive:1995/46", "directive:2022/2555"}
    assert seed.read_mappings(spark, str(tmp_path / "none.json")).count() == 0
    assert Store.load(spark, str(tmp_path / "db")).has("db_metadata")
    with pytest.raises(FileNotFoundError):
        Store.load(spark, str(tmp_path / "nowhere"))
    assert not any(repeated(t, store[t]).count() or lacking(t, store[t]).count() for t in KEYS)
    assert not any(orphans(store[t], c, store[to]).count() for t, c, to in REFERENCES)
    assert sorted(tuple(r) for r in load.attempts(seed.read_seed(spark, str(staged)), store).collect()) == [("definitions", 2, 1), ("legal_documents", 2, 2), ("legal_provisions", 3, 2)]
    (digest,) = seed.file_digests(spark, str(tmp_path / "map.json")).collect()
    assert len(digest["digest"]) == 12


def test_rows_that_break_constraints_keep_a_load_from_counting(spark, tmp_path):
    staged, folder = tmp_path / "seed", str(tmp_path / "db")
    staged.mkdir()
    none = seed.read_mappings(spark, str(tmp_path / "none.json"))
    write = lambda name, **more: (staged / name).write_text(json.dumps({"id": name, "title": name, "provisions": [{"provision_ref": "s1", "section": "1", "content": "text"}], "definitions": []} | more))
    write("a.json")
    load.build(spark, seed.read_seed(spark, str(staged)), none, "2026-01-01T00:00:00Z", folder)
    write("b.json", status="lost")
    write("c.json", title=None, provisions=[{"provision_ref": "s1", "section": "1", "content": None}])
    for _ in range(2):
        with pytest.raises(ConstraintError, match="legal_documents"):
            load.build(spark, seed.read_seed(spark, str(staged)), none, "2026-01-02T00:00:00Z", folder)
        assert [r["id"] for r in Store.load(spark, folder)["legal_documents"].collect()] == ["a.json"] and versions(spark, folder) == [0]
        bad = {(t, r["id"], *r["reasons"]) for t, df in rejected(spark, folder).items() for r in df.collect()}
        assert ("legal_documents", "b.json", "status: not allowed") in bad and {t for t, *_ in bad} <= {"legal_documents", "legal_provisions"}
        assert any(x[:2] == ("legal_documents", "c.json") and "title: lacking" in x for x in bad) or not any(x[1] == "c.json" for x in bad)
    write("b.json")
    (staged / "c.json").unlink()
    load.build(spark, seed.read_seed(spark, str(staged)), none, "2026-01-03T00:00:00Z", folder)
    assert Store.load(spark, folder)["legal_documents"].count() == 2 and rejected(spark, folder) == {}


def test_every_kind_of_constraint_is_judged(spark):
    docs = spark.createDataFrame([("a", "statute", "A", "in_force"), ("a", "bill", "B", "repealed"), ("b", "novel", None, None)], "id string, type string, title string, status string")
    rows = spark.createDataFrame([(1, "a", "s1", "1", "x"), (2, "a", "s1", "1", "y"), (3, "nowhere", "s1", "1", None), (4, "a", None, "1", "z")], "id long, document_id string, provision_ref string, section string, content string")
    tables = {"legal_documents": docs, "legal_provisions": rows}
    assert sorted((r["type"], sorted(r["reasons"])) for r in judged("legal_documents", docs, tables).collect()) == [("bill", ["id: shared"]), ("novel", ["status: lacking", "title: lacking", "type: not allowed"]), ("statute", ["id: shared"])]
    got = {r["id"]: sorted(r["reasons"]) for r in judged("legal_provisions", rows, tables).collect()}
    assert got == {1: ["document_id, provision_ref: shared"], 2: ["document_id, provision_ref: shared"], 3: ["content: lacking", "document_id: names no row of legal_documents"], 4: ["provision_ref: lacking"]}
    assert judged("eu_documents", spark.createDataFrame([("x", "directive", 1900, 0)], "id string, type string, year int, number int"), {}).first()["reasons"] == ["year: not allowed", "number: not allowed"]


def test_a_store_is_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "db")
    table = lambda i: Store(spark, {"db_metadata": spark.createDataFrame([("built_at", str(i))], "key string, value string"), "definitions": spark.createDataFrame([(i,)], "id long")})
    for i in range(4):
        table(i).save(folder)
    assert versions(spark, folder) == [2, 3]
    broken = table(9)
    broken.tables["definitions"] = spark.createDataFrame([("x",)], "s string").selectExpr("raise_error(s) AS id")
    with pytest.raises(Exception):
        broken.save(folder)
    read = Store.load(spark, folder)
    assert read["db_metadata"].first()["value"] == "3" and read["definitions"].first()["id"] == 3
    table(5).save(folder)
    assert Store.load(spark, folder)["definitions"].first()["id"] == 5
    monkeypatch.setenv(STORE_VARIABLE, folder)
    assert Store.open(spark)["definitions"].first()["id"] == 5
    monkeypatch.delenv(STORE_VARIABLE)
    assert Store.open(spark, candidates=(str(tmp_path / "none"), folder)).has("definitions")
    with pytest.raises(FileNotFoundError, match=STORE_VARIABLE):
        Store.open(spark, candidates=(str(tmp_path / "none"),))


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).selectExpr("pmod(xxhash64(id), 100000) AS a", "id AS b").repartition(7)
    got = load.numbered(rows, "a", "b").orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 5001)) and [(r["a"], r["b"]) for r in got] == sorted((r["a"], r["b"]) for r in got)


def test_deferred_blocks_and_kept_discoveries(spark):
    pages = spark.createDataFrame([("a", "<p>1</p>"), ("b", "<p>2</p>")], "document_id string, html string")
    blocks = spark.createDataFrame([("a", 1, "later"), ("a", 0, "sooner")], "document_id string, chunk int, body string")
    assert {tuple(r) for r in dedupe.hydrated(pages, blocks).collect()} == {("a", "<p>1</p>\n\nsooner\nlater"), ("b", "<p>2</p>")}
    caches = spark.createDataFrame([(1, True, 50, ["x"]), (2, False, 50, ["x"]), (3, True, 20, ["x"]), (4, True, 50, []), (5, True, 50, None), (6, None, 50, ["x"])], "k int, in_force_only boolean, page_size int, laws array<string>")
    assert [r["k"] for r in dedupe.fresh_cache(caches, True, 50).collect()] == [1]
    assert seed.is_current("abc  file", "abc") and not seed.is_current("abc", "abd") and not seed.is_current("", "abc") and not seed.is_current(None, None)


def test_pages(spark, tmp_path):
    (tmp_path / "act-1.html").write_text('<span class="jhId" id="SZ1"></span><div class="szakasz">1. § egy</div>')
    pages = seed.read_html(spark, str(tmp_path))
    (row,) = parse_html.provisions(pages).collect()
    assert (row["document_id"], row["provision_ref"], row["content"], row["chapter"]) == ("act-1", "s1", "1. § egy", None)
    assert parse_html.provisions(spark.createDataFrame([("x", None), ("y", "")], "id string, html string")).count() == 0


def test_pages_without_sections(spark):
    mark = lambda i, css, said: f'<span class="jhId" id="B{i}"></span> <div class="{css}">{said}</div> '
    bare = mark(0, "fejezet", "I. heading") + mark(1, "preambulum", "first") + mark(2, "other", "no") + mark(3, "pont", "<b> </b>") + mark(4, "pont", "second") + '<span class="jhId" id="B5"></span> \n'
    whole = mark(0, "preambulum", "before") + mark(1, "szakasz", "7. § text") + mark(2, "pont", "more")
    pages = spark.createDataFrame([("a", bare), ("b", whole), ("c", mark(0, "other", "x")), ("d", None)], "id string, html string").repartition(3)
    got = [tuple(r) for r in parse_html.provisions(pages).orderBy("document_id", "pos").select("document_id", "pos", "provision_ref", "chapter", "section", "title", "content").collect()]
    assert got == [("a", 1, "s1", None, "1", "1", "first"), ("a", 4, "s2", None, "2", "2", "second"), ("b", 1, "s7", None, "7", "7. §", "7. § text more")]


def test_a_no_break_space_is_a_space(spark):
    text = "Article\u00a07 of Regulation\u00a0(EU)\u202f2016/679 and Directive\u20032000/31/EC"
    rows = extract.eu_references(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").collect()
    assert {(r["eu_document_id"], r["eu_article"]) for r in rows} == {("regulation:2016/679", "7"), ("directive:2000/31", "7")}


def test_references_have_places(spark):
    text = "x" * 200 + " Directive 2000/1 and Directive 2000/1/EC; Article 5 of directive 99/2. " + "y" * 200
    rows = extract.eu_references(spark.createDataFrame([(1, text), (2, None), (3, "Regulation")], "k long, t string"), "k", "t").collect()
    got = {(r["eu_document_id"], r["eu_article"]): r for r in rows}
    assert set(got) == {("directive:2000/1", "5"), ("directive:1999/2", "5")}
    first = got["directive:2000/1", "5"]
    assert first["full_citation"] == "Directive 2000/1/EC" and text[first["at"] - 1 :].startswith("Directive 2000/1/EC")


def test_references_equal_three_searches_one_after_the_other(spark):
    """One pass finds what each notation, searched by itself, finds, with places and contexts."""
    rng, texts = random.Random(5), [None, "", "Regulation", "x" * 5000 + " Directive 2000/1/EC " + "y" * 5000]
    words = ["Regulation", "directive", "(EU)", "(eec)", "No", "No.", "2016/679", "95/46/EC", "16/1/EU", "1/2", "2000/31/ECx", "99/2/Euratom/EC", "12345/1", "0/5", "2010/00", "Article 5(2)", "transpose", ",", " ", "\n", "\0", "sub", "Regulation(EC)", "DIRECTIVE2001/9"]
    texts += ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    space = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
    start, end, of = r"(?<![0-9A-Za-z_])(Regulation|Directive)" + space + "*", r"(?![0-9A-Za-z_])", "(EU|EC|EEC|Euratom)"
    act = rf"(?:No\.?{space}*)?([0-9]{{2,4}})/([0-9]{{1,4}})"
    notations = ((rf"{start}\({of}\){space}*{act}{end}", 3, 4, 2), (rf"{start}{act}/{of}{end}", 2, 3, 4), (rf"{start}{act}{end}", 2, 3, None))
    want = {}
    for k, text in enumerate(texts):
        for n, (pattern, y, num, of_group) in enumerate(notations):
            for m in re.finditer(pattern, text or "", re.IGNORECASE | re.ASCII):
                year, number = int(m[y]), int(m[num])
                year += 0 if len(m[y]) > 2 else 1900 if year >= 50 else 2000
                if year <= 0 or number <= 0:
                    continue
                around = re.sub(space + "+", " ", text[max(0, m.start() - 120) : m.end() + 120]).strip(" ")
                article = re.search(rf"(?<![0-9A-Za-z_])Article{space}+([0-9]+[A-Za-z]?(?:\([0-9]+\))?)", around, re.IGNORECASE | re.ASCII)
                found = (n, m.start() + 1, m[of_group].upper() if of_group else "EU", m[0], around)
                want.setdefault((k, f"{m[1].lower()}:{year}/{number}", article[1] if article else None), found)
    rows = extract.eu_references(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").collect()
    got = {(r["k"], r["eu_document_id"], r["eu_article"]): (r["pattern"], r["at"], r["community"], r["full_citation"], r["reference_context"]) for r in rows}
    assert len(rows) == len(got) and len(want) > 300 and {v[0] for v in want.values()} == {0, 1, 2} and got == want


def test_a_file_for_each_act(spark, tmp_path):
    folder = str(tmp_path / "acts")
    acts = spark.createDataFrame([("act-a", "Á", [("x", None)]), ("b/c", "B", []), (".d", None, None)], "id string, title string, definitions array<struct<term:string,definition:string>>").repartition(3)
    json_files.write_json_files(acts, "id", folder)
    files = {p.name: p.read_text() for p in (tmp_path / "acts").iterdir()}
    assert files == {"act-a.json": '{\n  "id": "act-a",\n  "title": "Á",\n  "definitions": [\n    {\n      "term": "x"\n    }\n  ]\n}\n', "b%2Fc.json": '{\n  "id": "b/c",\n  "title": "B",\n  "definitions": []\n}\n', "%2Ed.json": '{\n  "id": ".d"\n}\n'}
    assert {r["id"] for r in seed.read_seed(spark, folder).collect()} == {"act-a", "b/c", ".d"}
    broken = acts.selectExpr("id", "IF(id = 'b/c', raise_error('lost'), title) AS title")
    for bad in (broken, acts.union(acts), acts.selectExpr("NULLIF(id, 'b/c') AS id", "title")):
        with pytest.raises(Exception):
            json_files.write_json_files(bad, "id", folder)
        assert {p.name: p.read_text() for p in (tmp_path / "acts").iterdir()} == files and [p.name for p in tmp_path.iterdir()] == ["acts"]
    json_files.write_json_files(acts.where("id = 'act-a'"), "id", folder)
    assert [p.name for p in (tmp_path / "acts").iterdir()] == ["act-a.json"]
    json_files.write_json_files(acts.limit(0), "id", folder)
    assert list((tmp_path / "acts").iterdir()) == []

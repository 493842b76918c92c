"""The tools over a small store with a statute of each status."""

import pytest

from lexmill.operators import citation, relations, reports, resolve, search
from lexmill.operators.index import Index
from lexmill.schema import Store, violations


def make(spark, without=()):
    docs = [("doc-inforce", "In Force Act", "IFA", "in_force", "2020-01-01", "2020-06-01"), ("doc-amended", "Amended Act", "AA", "amended", "2018-01-01", "2018-06-01"), ("doc-repealed", "Repealed Act", "RA", "repealed", "2010-01-01", "2010-06-01"), ("doc-future", "Future Act", "FA", "not_yet_in_force", "2030-01-01", "2031-01-01")]
    provisions = [(1, "doc-inforce", "s1", "I. Fejezet", "1", "1. §", "A személyes adat és az elektronikus aláírás."), (2, "doc-inforce", "s2", "I. Fejezet", "2", "2. §", "A kiberbiztonsági információs rendszer."), (3, "doc-amended", "s3", "II. Fejezet", "3", "3. §", "Az üzleti titok, létfontosságú adat.")]
    acts = [("regulation:2016/679", "regulation", 2016, 679, "GDPR", "GDPR", "data"), ("directive:2022/2555", "directive", 2022, 2555, "NIS2", "NIS2", "security")]
    refs = [("doc-inforce", 1, "regulation:2016/679", "Article 6", "implements", "complete", 1), ("doc-amended", 3, "directive:2022/2555", None, "references", "partial", 0), ("doc-amended", 3, "regulation:2016/679", None, "references", "unknown", 0)]
    tables = {
        "legal_documents": spark.createDataFrame([(i, t, f"{t} EN", s, st, a, b, f"https://njt.hu/jogszabaly/{i}") for i, t, s, st, a, b in docs], "id string, title string, title_en string, short_name string, status string, issued_date string, in_force_date string, url string"),
        "legal_provisions": spark.createDataFrame(provisions, "id long, document_id string, provision_ref string, chapter string, section string, title string, content string"),
        "definitions": spark.createDataFrame([(1, "doc-inforce", "személyes adat", None, "Egy mondat.", "s1")], "id long, document_id string, term string, term_en string, definition string, source_provision string"),
        "eu_documents": spark.createDataFrame(acts, "id string, type string, year int, number int, title string, short_name string, description string"),
        "eu_references": spark.createDataFrame([(i, *r, None, None) for i, r in enumerate(refs)], "id long, document_id string, provision_id long, eu_document_id string, eu_article string, reference_type string, implementation_status string, is_primary_implementation int, reference_context string, full_citation string"),
        "db_metadata": spark.createDataFrame([("tier", "free"), ("schema_version", "1.0"), ("built_at", "2026-02-21T00:00:00Z")], "key string, value string"),
    }
    return Store(spark, {k: v for k, v in tables.items() if k not in without})


@pytest.fixture(scope="module")
def store(spark):
    return make(spark)


def names(spark, *said):
    return spark.createDataFrame([(s,) for s in said], "said string")


def test_resolver(spark, store):
    docs = store["legal_documents"]
    assert [resolve.resolve_one(docs, s) for s in ("  ", "doc-inforce", "In Force Act EN", "ifa", "no such act", None)] == [None, "doc-inforce", "doc-inforce", "doc-inforce", None, None]
    got = {r["said"]: r["document_id"] for r in resolve.resolve(docs, names(spark, "", "doc-inforce", "force act", "IFA", "nothing")).collect()}
    assert got == {"": None, "doc-inforce": "doc-inforce", "force act": "doc-inforce", "IFA": "doc-inforce", "nothing": None}


def test_names_in_titles_answer_alike_one_by_one_and_as_a_table(spark, store):
    docs = store["legal_documents"]
    said = ["%", "_", "_%_", "f_ture", "%act%", "ct", "A", "a", "in", "ure act en", "x%y", "_" * 16, "_" * 40, "in force_act", "é", "Act%EN", " AMENDED ", "e"]
    got = {r["said"]: r["document_id"] for r in resolve.resolve(docs, names(spark, *said)).collect()}
    assert got == {s: resolve.resolve_one(docs, s) for s in said}
    assert "NestedLoop" not in resolve.resolve(docs, names(spark, *said))._jdf.queryExecution().executedPlan().toString()


def test_search_ladder(store):
    rows = search.search(store, "személyes adat").rows.collect()
    assert [r["provision_ref"] for r in rows] == ["s1"] and ">>>személyes<<< >>>adat<<<" in rows[0]["snippet"]
    assert {r["provision_ref"] for r in search.search(store, "ADAT").rows.collect()} == {"s1", "s3"}
    assert {r["provision_ref"] for r in search.search(store, "adat", document="Amended Act").rows.collect()} == {"s3"}
    assert search.search(store, "adat", status="repealed").rows.count() == 0
    loose = search.search(store, "adat xyzzyflurble")
    assert loose.rows.count() == 2 and loose.strategy == "broadened"
    like = search.search(store, "titok, létfontosságú")
    assert like.rows.count() == 1 and like.strategy is None  # inside a quoted phrase a comma does no harm
    hyphen = search.search(store, "titok-adat")
    assert hyphen.rows.count() == 0 and hyphen.strategy is None
    assert search.search(store, "xyzzyflurble99").rows.count() == 0
    assert search.search(store, "  ").rows.count() == 0
    missing = search.search(store, "adat", document="no such act")
    assert missing.rows.count() == 0 and "no such act" in missing.note
    signs = search.search(store, "()")
    assert signs.strategy == "like_fallback" and signs.rows.count() == 3
    assert 1 <= search.stance(store, "személyes adat", limit=100).rows.count() <= 20
    assert "chapter" not in search.stance(store, "adat").rows.columns


def test_provisions(store):
    assert [r["section_number"] for r in citation.get_provision(store, "In Force Act").rows.collect()] == ["1", "2"]
    assert [r["provision_ref"] for r in citation.get_provision(store, "doc-inforce", "2").rows.collect()] == ["s2"]
    assert "999" in citation.get_provision(store, "doc-inforce", "999").note
    assert "nothing" in citation.get_provision(store, "nothing").note


def test_citations(spark, store):
    said = ["", "Section 1 Missing Act", "In Force Act s 1", "Section 999 In Force Act", "Amended Act", "Repealed Act", "In Force Act Section 1"]
    got = {r["citation"]: r for r in citation.validate_citations(store, spark.createDataFrame([(s,) for s in said], "citation string")).collect()}
    assert [got[s]["valid"] for s in said] == [False, False, True, False, True, True, True]
    assert got["In Force Act s 1"]["provision_ref"] == "s1" and got["In Force Act s 1"]["normalized"] == "In Force Act 1. § (Section 1)"
    assert got["Section 999 In Force Act"]["document_id"] == "doc-inforce" and len(got["Section 999 In Force Act"]["warnings"]) == 1
    assert got["Amended Act"]["warnings"][0].startswith("Note") and got["Repealed Act"]["warnings"][0].startswith("WARNING")
    cite = spark.createDataFrame([("Section 3, In Force Act",), ("In Force Act s 3",), ("In Force Act",), ("2012. évi I. törvény 116. §",)], "citation string")
    full = {r["original"]: r["formatted"] for r in citation.format_citations(store, cite).collect()}
    assert full == {"Section 3, In Force Act": "In Force Act 3. §", "In Force Act s 3": "In Force Act 3. §", "In Force Act": "In Force Act", "2012. évi I. törvény 116. §": "2012. évi I. törvény 116. §"}
    pin = {r["original"]: r["formatted"] for r in citation.format_citations(store, cite, "pinpoint").collect()}
    assert pin["In Force Act s 3"] == "3. §" and pin["In Force Act"] == "In Force Act"


def test_currency(spark, store):
    got = {r["said"]: r for r in citation.check_currency(store, names(spark, "missing-doc", "doc-repealed", "doc-future", "doc-inforce")).collect()}
    assert got["missing-doc"]["status"] == "not_found" and got["missing-doc"]["title"] == "Unknown"
    assert [len(got[d]["warnings"]) for d in ("missing-doc", "doc-repealed", "doc-future", "doc-inforce")] == [1, 1, 1, 0]


def test_edges(store):
    (r,) = relations.eu_basis(store, "doc-inforce", True, ["implements"]).rows.collect()
    assert r["articles"] == ["Article 6"] and r["eu_document_title"] == "GDPR"
    assert [r["document_id"] for r in relations.implementations(store, "regulation:2016/679", primary_only=True).rows.collect()] == ["doc-inforce"]
    assert {r["status"] for r in relations.implementations(store, "regulation:2016/679", in_force_only=True).rows.collect()} == {"in_force"}
    assert relations.eu_search(store, "gdpr", "regulation", 2015, 2016, True, 500).rows.count() == 1
    assert relations.eu_search(store).rows.count() == 2 and relations.eu_search(store, limit=0).rows.count() == 1
    assert [relations.provision_eu_basis(store, d, ref).rows.count() for d, ref in (("missing-doc", "1"), ("doc-inforce", "999"), ("doc-inforce", "1"))] == [0, 0, 1]


def test_compliance(spark, store):
    state = {r["document_id"]: r for r in relations.compliance(store).collect()}
    assert state["doc-inforce"]["compliance_status"] == "compliant" and state["doc-amended"]["compliance_status"] == "partial"
    assert state["doc-future"]["compliance_status"] == "not_applicable" and len(state["doc-future"]["recommendations"]) == 1
    more = make(spark)
    extra = spark.createDataFrame([(7, "doc-repealed", None, "x", None, "references", "partial", 0, None, None), (8, "doc-future", None, "x", None, "references", "unknown", 0, None, None)], more["eu_references"].schema)
    more.tables["eu_references"] = more["eu_references"].unionByName(extra)
    state = {r["document_id"]: r for r in relations.compliance(more).collect()}
    assert state["doc-repealed"]["compliance_status"] == "partial" and state["doc-repealed"]["recommendations"] and len(state["doc-repealed"]["warnings"]) == 2
    assert state["doc-future"]["compliance_status"] == "unclear" and state["doc-future"]["recommendations"]
    assert relations.validate_compliance(store, "nothing").first()["compliance_status"] == "not_applicable"


def test_missing_tables(spark):
    bare = make(spark, ("definitions", "eu_documents", "eu_references", "db_metadata"))
    assert {r["name"]: r["n"] for r in reports.about(bare).collect()} == {"legal_documents": 4, "legal_provisions": 3, "definitions": 0}
    assert relations.eu_basis(bare, "doc-inforce").note and relations.eu_basis(bare, "doc-inforce").rows.count() == 0
    assert relations.eu_search(bare).note.startswith("EU documents") and relations.implementations(bare, "x").note
    assert {r["compliance_status"] for r in relations.compliance(bare).collect()} == {"not_applicable"}
    (r,) = reports.list_sources(bare).collect()
    assert (r["tier"], r["schema_version"], r["built_at"], r["document_count"]) == ("free", "1.0", None, 4)
    assert reports.healthy(bare) and not reports.healthy(Store(spark, {}))


def test_a_table_that_is_dropped_is_no_longer_available(spark):
    make(spark).register("t_")
    there = {r["name"]: (r["available"], r["rows"]) for r in reports.capabilities(Store.of_catalog(spark, "t_")).collect()}
    assert there["legal_documents"] == (True, 4) and there["eu_references"][0] and there["legal_provisions"] == (True, 3)
    spark.catalog.dropTempView("t_eu_references")
    left = Store.of_catalog(spark, "t_")
    assert {r["name"]: (r["available"], r["rows"]) for r in reports.capabilities(left).collect()} == there | {"eu_references": (False, 0)}
    assert relations.eu_basis(left, "doc-inforce").note and reports.healthy(left)


def test_constraints(spark):
    rows = spark.createDataFrame([("a", "bill", "in_force"), ("b", "novel", "in_force"), ("c", "statute", "lost")], "id string, type string, status string")
    assert {(r["id"], r["violation"]) for r in violations("legal_documents", rows).collect()} == {("b", "type"), ("c", "status")}


def test_a_gram_that_all_titles_share(spark, store, monkeypatch):
    """Names whose every gram is common meet titles in rounds, and no round pairs them all."""
    monkeypatch.setattr(resolve, "HOT", 10)
    ids = [f"d{i:04d}" for i in range(600)]
    docs = spark.createDataFrame([(i, f"act of the realm {int(i[1:]) % 7}", None if int(i[1:]) % 2 else "THE REALM", None) for i in ids], "id string, title string, short_name string, title_en string")
    pairs, held = [], resolve._held

    def counting(met, titles, column):
        pairs.append(met.count())
        return held(met, titles, column)

    monkeypatch.setattr(resolve, "_held", counting)
    said = ["act of the realm", "the realm", "of the realm 6", "t_e realm", "realm 9", "re", "m", "%", "the realm of"]
    got = {r["said"]: r["document_id"] for r in resolve.resolve(docs, names(spark, *said)).collect()}
    assert got == {s: resolve.resolve_one(docs, s) for s in said}
    assert got["act of the realm"] == "d0000" and got["of the realm 6"] == "d0006" and got["realm 9"] is None
    assert max(pairs) <= 600 and sum(pairs) < 0.5 * len(said) * 600


def test_stored_index(spark, store, tmp_path):
    rows = store["legal_provisions"]
    stored = Index.build(rows, f"{tmp_path}/index")
    assert stored.ranked(["adat"], every=True).count() == 2
    again = Index.open(spark, f"{tmp_path}/index")
    assert vars(again) == vars(stored) and again.rows == rows.count()


def test_index_of_a_stream(spark, store, tmp_path):
    from lexmill.streaming.index import maintain_index

    store["legal_provisions"].write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(store["legal_provisions"].schema).parquet(f"{tmp_path}/in")
    maintain_index(stream, f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    stored = Index.open(spark, f"{tmp_path}/index")
    assert stored.rows == 3 and stored.having(["adat", "nothing"]) == {"adat": 2, "nothing": 0}


def test_rows_of_an_index_change_and_go(spark, tmp_path):
    from lexmill.streaming.index import maintain_index

    schema = "id long, content string, title string, deleted boolean, version long"
    batches = [[(1, "one fish", "", None, 1), (2, "two fish", "", None, 1), (3, "red fish", "", None, 1)], [(2, "two birds", "", False, 2), (2, "a bird", "", False, 3), (3, None, None, True, 2)], [(3, "blue fish", "", None, 4)]]
    want = [{1, 2, 3}, {1}, {1, 3}]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        maintain_index(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
        stored = Index.open(spark, f"{tmp_path}/index")
        assert {r["id"] for r in stored.ranked(["fish"]).collect()} == want[k] and stored.rows == len(want[k]) + (k > 0)
    assert {r["token"] for r in stored.matching({"a", "bird", "two", "birds"}).where("id = 2").collect()} == {"a", "bird"}


def test_what_a_store_says_of_itself(spark, store):
    record = reports.about_record(store, "1.0")
    assert record["stats"]["documents"] == 4 and record["freshness"]["database_built"] == "2026-02-21T00:00:00Z" and record["data_sources"][0]["url"] == "https://njt.hu"
    assert len(record["fingerprint"]) == 12 and record["fingerprint"] == reports.fingerprint(make(spark)) != reports.fingerprint(make(spark, ("definitions", "legal_provisions")))

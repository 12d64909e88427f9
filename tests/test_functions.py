"""Column functions, chunks, parsing and settings on small cases."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.functions import relations as R
from loomgraph.functions import texts as T
from loomgraph.functions.chunks import chunk_spans, chunked
from loomgraph.sources import config, domains, ingest, providers


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "x string").coalesce(1)
    return [list(r) for r in zip(*df.select(*columns).collect())]


def test_ids_and_names(spark):
    ids, norm, key = values(spark, ["Alice Smith", "  Café Ørsted--Inc. ", "Dr. Prof. José Núñez", "Senior Agents"], N.entity_id(F.col("x"), F.lit("PERSON")), N.normalized(F.col("x")), N.dedup_key(F.col("x")))
    assert ids == ["person:alice_smith", "person:cafe_orsted_inc", "person:dr_prof_jose_nunez", "person:senior_agents"]
    assert norm[2] == "jose nunez" and key[3] == "senior agent"
    assert [N.singular(w) for w in ("parties", "boxes", "people", "series", "glass", "cats")] == ["party", "box", "person", "series", "glass", "cat"]


def test_relation_types(spark):
    active, syn, inv = values(spark, ["OWNED_BY", "STUDIED_BY", "LED_BY", "OWNS", "A_MULTI_USED_BY"], R.active_form(F.col("x")), R.synonym(F.col("x")), R.inverse_label(F.col("x")))
    assert active == ["OWNS", "STUDIES", "LES", None, None] and syn[3] is None and inv[3] == "owned by"


def test_ocr_text(spark):
    (got,) = values(spark, ["exam-\nple", "a\n\n\n\n\nb", "one\ntwo", "End.\nNext", "  x-\ny\nz\n\n\nW "], T.ocr_normalized(F.col("x")))
    assert got == ["example", "a\n\nb", "one two", "End.\nNext", "xy z\n\nW"]


def test_dates_phrases_numbers(spark):
    date, filler = values(spark, ["on 2021-03-04 and 2022", "in 1999", "none"], T.date_in(F.col("x")), F.size(T.filler_phrases(F.concat("x", F.lit(" Served As ")))))
    assert date == ["2021-03-04", "1999", None] and filler == [1, 1, 1]
    (c,) = values(spark, ["0.5", "7", "-1", "abc", None], T.clamped(F.col("x")))
    assert c == [0.5, 1.0, 0.0, 0.5, 0.5]


def test_chunks_cover_every_text(spark):
    text = " ".join(f"Sentence number {i}." for i in range(200))
    spans = chunk_spans(text, 500, 0.1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:]))
    assert all(e - s <= 500 for s, e in spans) and chunk_spans("", 500) == [(0, 0)] and len(chunk_spans("short", 500)) == 1
    with pytest.raises(ValueError):
        chunk_spans(text, 500, 0.7)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert chunked(df, 500).groupBy("doc_id").count().count() == 2


def test_answers_of_models():
    for text in ('{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} done', '{bad {"a": 1}'):
        assert ingest.json_object(text) == {"a": 1}
    with pytest.raises(ValueError):
        ingest.json_object("no json")
    entities, relations = providers.read_answer(json.dumps({"entities": [{"name": "A"}, {"name": "B", "confidence": 7}, {"x": 1}], "relations": [{"source_entity": "A", "target_entity": "B", "confidence": 0.4}, {}]}))
    assert entities == [("A", "UNKNOWN", {}, 0.5, "")] and relations == [("ASSOCIATED_WITH", "A", "B", 0.4, "")]


def test_files_to_text(tmp_path, spark):
    assert ingest.html_text("<head><title>t</title></head><p>a <b>b</b></p><script>x</script>") == "a\nb"
    assert ingest.decoded("é".encode("latin-1")) == "é"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="urn:w"><w:p><w:t>One</w:t></w:p><w:p/><w:p><w:t>Two</w:t></w:p></w:document>')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.TXT").write_text("plain")
    (tmp_path / "b.exe").write_text("no")
    (tmp_path / "c.docx").write_bytes(b"broken")
    rows = {r.doc_id: r for r in ingest.documents(spark, str(tmp_path)).collect()}
    assert rows["d"].text == "One\n\nTwo" and rows["a"].text == "plain" and rows["c"].error and "b" not in rows
    with pytest.raises(ValueError):
        ingest.supported("other")
    with pytest.raises(ValueError):
        ingest.discovered(spark, str(tmp_path / "missing"))


def test_domains(tmp_path):
    assert domains.bundled_names() == ["academic", "general", "osint", "schema-free"]
    assert domains.bundled("osint").review_types() == ("BENEFICIAL_OWNER_OF", "TRANSACTED_WITH")
    path = tmp_path / "d.yaml"
    path.write_text("domain:\n  name: mine\n  entity_types: {person: a human}\n  relation_types:\n    knows: {source_types: [person], target_types: [Person], symmetric: true}\n")
    d = domains.loaded(str(path))
    assert d.entity_types["PERSON"].description == "a human" and d.rules() == {"KNOWS": (["PERSON"], ["PERSON"], True)}
    domains.save(d, str(tmp_path / "discovered_domain.yaml"))
    assert domains.found_domain(str(tmp_path)).rules() == d.rules() and domains.found_domain("/nowhere") is None


def test_settings_in_layers(tmp_path, monkeypatch):
    (tmp_path / "loom.yaml").write_text("model: a/b\nextraction: {backend: legacy}\nrpm: 7\n")
    (tmp_path / ".env").write_text("LOOM_RPM=8\n")
    c = config.load(str(tmp_path), chunk_size=123)
    assert (c.model, c.extractor, c.rpm, c.chunk_size) == ("a/b", "legacy", 8, 123)
    monkeypatch.setenv("LOOM_RPM", "9")
    assert config.load(str(tmp_path)).rpm == 9
    with pytest.raises(ValueError):
        config.load(str(tmp_path), extractor="none")
    with pytest.raises(ValueError):
        config.check_key("somebody/model")


def test_retries_and_limits():
    waits, answers = [], iter([ValueError("x"), "", "fine"])

    def call(_):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert providers.Remote("m", call, sleep=waits.append).answer("p") == "fine" and len(waits) == 2
    now, slept = [0.0], []
    limiter = providers.Limiter(2, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        limiter.wait()
    assert slept == [60.0]


def test_extraction_holds_a_few_texts_at_a_time(spark):
    import pyarrow as pa

    from loomgraph.functions import chunks
    from loomgraph.plans import extract
    from loomgraph.sources.domains import bundled

    class Frame:  # what a task is given and gives, without Spark
        columns = ("doc_id",)

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = ["In spring Alice Smith met Bob Jones. " * 40] * 1000
    docs = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(1000)], "text": texts})
    cut = list(chunks.chunked(Frame(), 500)(iter([docs])))
    assert len({i for b in cut for i in b.column(0).to_pylist()}) == 1000 and max(b.num_rows for b in cut) < 1000
    whole = pa.Table.from_batches(cut).select(["doc_id", "text", "chunk_index", "total_chunks"]).combine_chunks().to_batches()
    found = list(extract.found_in_chunks(Frame(), bundled("general"))(iter(whole)))
    assert sum(b.num_rows for b in found) == sum(b.num_rows for b in whole) and max(b.num_rows for b in found) <= 32
    first = found[0].to_pylist()[0]
    assert {e["name"] for e in first["entities"]} >= {"Alice Smith", "Bob Jones"} and first["relations"] and not first["failed"]

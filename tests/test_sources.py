import json
import threading

import pytest
from pyspark.sql import functions as F

from quarry.sources import documents as S


def test_knowledge_base_and_links(spark, tmp_path):
    base = {
        "source": "g",
        "guideline_pages": [
            {"page_id": "p1", "pdf_page": 1, "clean_text": "a", "printed_page_code": "AB-1", "outgoing_links": [{"target_pdf_page": 2, "anchor_text": "go"}], "extra": 1},
            {"page_id": "p2", "pdf_page": 2, "printed_page_code": "AB-2", "page_type": "discussion"},
        ],
        "discussion_chunks": [{"chunk_id": "c1", "article_id": "x", "clean_text": "t"}],
        "reference_entries": [{"entry_id": "r1", "article_id": "x", "ref_number": "3", "source": "own"}],
    }
    (tmp_path / "kb.json").write_text(json.dumps(base, indent=1))
    kb = S.read_knowledge_base(spark, str(tmp_path / "kb.json"))
    assert [(r["page_id"], r["page_type"], r["needs_review"], r["source"]) for r in kb["pages"].orderBy("pos").collect()] == [("p1", "clinical_guideline", False, "g"), ("p2", "discussion", False, "g")]
    assert kb["chunks"].first()["content_type"] == "text" and kb["chunks"].first()["reference_ids"] == []
    assert kb["references"].first()["source"] == "own"
    assert S.resolve_link_codes(kb["links"], kb["pages"]).first()["target_code"] == "AB-2"


def test_chunk_files_in_both_shapes(spark, tmp_path):
    rows = [{"chunk_id": f"c{k}", "clean_text": "t"} for k in range(3)]
    for name, data in (("a", rows), ("b", {"count": 3, "chunks": rows})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(json.dumps(data))
        assert [r["chunk_id"] for r in S.read_chunks(spark, str(tmp_path / name)).orderBy("pos").collect()] == ["c0", "c1", "c2"]


def test_review_decisions_in_three_shapes(spark, tmp_path):
    rows = [{"triple_id": "t1", "decision": "approve"}, {"triple_id": " "}, {"triple_id": "t1", "validation_status": "reject", "confidence": 0.4}]
    for k, data in enumerate((rows, {"decisions": rows}, {"items": rows})):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "x.json").write_text(json.dumps(data))
        got = S.read_review_decisions(spark, str(tmp_path / str(k))).collect()
        assert [(r["triple_id"], r["decision"], r["new_confidence"]) for r in got] == [("t1", "reject", 0.4)]


def test_literature_xml(spark, tmp_path):
    (tmp_path / "x.xml").write_text("""<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">77</PMID><Article><ArticleTitle>T</ArticleTitle>
      <Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2021 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal>
      <Abstract><AbstractText Label="AIM">one</AbstractText><AbstractText>two</AbstractText></Abstract><Language>eng</Language>
      <PublicationTypeList><PublicationType UI="1">Review</PublicationType></PublicationTypeList></Article>
      <MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="Y">A</DescriptorName></MeshHeading><MeshHeading><DescriptorName MajorTopicYN="N">B</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
      <PubmedData><ArticleIdList><ArticleId IdType="pubmed">77</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>""")
    r = S.read_articles(spark, str(tmp_path / "x.xml")).first()
    assert (r["pmid"], r["title"], r["abstract"], r["year"], r["doi"]) == ("77", "T", "AIM: one\ntwo", "2021", "10.1/x")
    assert (r["pub_types"], r["mesh"], r["mesh_major"], r["language"]) == (["Review"], ["A", "B"], ["A"], "eng")


def test_event_text_there_and_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "token", "a"), (2, "final", "b")], "i int, kind string, text string").coalesce(1)
    text = "".join(r[0] for r in rows.orderBy("i").select(S.event_text(F.col("kind"), F.col("text"))).collect())
    (tmp_path / "e.txt").write_text(": comment\n\n" + text + "data: broken\n\n")
    got = [r["event"] for r in S.read_events(spark, str(tmp_path / "e.txt"), "type string, payload string").collect()]
    assert [(e["type"], e["payload"]) for e in got if e and e["type"]] == [("token", "a"), ("final", "b")]


def test_json_in_texts(spark):
    rows = spark.createDataFrame([('so {"a": 1} there', '["x"]'), ("none", "nope"), (None, None)], "t string, l string")
    got = rows.select(S.first_json(F.col("t"), "a int").alias("j"), S.json_list(F.col("l")).alias("l")).collect()
    assert [r["j"] and r["j"]["a"] for r in got] == [1, None, None] and [r["l"] for r in got] == [["x"], [], []]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "x"')], "id int, text string")
    S.write_csv(rows, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert text.splitlines() == ["﻿id,text", '1,"say ""x"""']
    many = spark.range(1000).select("id", F.concat(F.lit("a,\n"), "id").alias("text")).repartitionByRange(7, "id").sortWithinPartitions("id")
    S.write_csv(many, str(tmp_path / "many"))
    joined = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "many").glob("part-*.csv")))
    assert joined == "\ufeffid,text\n" + "".join(f'{k},"a,\n{k}"\n' for k in range(1000))
    pages = spark.createDataFrame([(2, None, "two"), (1, "A-1", "one")], "pdf_page int, printed_page_code string, clean_text string")
    S.write_markdown(pages.coalesce(1), str(tmp_path / "md"))
    assert "## Page 1 · A-1\n\none" in "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    for _ in range(2):
        S.append_trace(rows, str(tmp_path / "trace"), "r", "e")
    assert spark.read.json(str(tmp_path / "trace")).count() == 2


def test_upsert_and_build_once(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, at int")
    assert sorted(map(tuple, S.upsert(table, changes, ["k"], "at").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    made = []
    for _ in range(2):
        out = S.build_once(spark, str(tmp_path / "t"), lambda: made.append(1) or table)
        assert out.count() == 2
    assert made == [1]


def test_tables_of_a_scope_are_deleted_and_no_others(spark):
    from quarry import tables

    kept, other = tables.new_path(spark, "kept"), []
    with tables.scope(spark) as folder:
        first = tables.stage(spark.range(3), "one")
        thread = threading.Thread(target=lambda: other.append(tables.stage(spark.range(5), "other")))
        thread.start()
        thread.join()
        with pytest.raises(ZeroDivisionError), tables.scope(spark) as inner:
            assert inner.startswith(folder)
            second = tables.stage(spark.range(4), "two")
            1 / 0
        assert first.count() == 3
        with pytest.raises(Exception, match="(?i)not exist|no such"):
            second.count()
        first.write.parquet(kept)
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        first.count()
    # What was saved outside, and what another job wrote meanwhile, is still there.
    assert spark.read.parquet(kept).count() == 3 and other[0].count() == 5

"""Chat, lines, decontamination, personal data, quality and mixing on small rows."""

import hashlib
import math
import random
import re

import pytest
from oracle import expected, rows
from pyspark.sql import functions as F

from quarry.llm import chat, decontaminate, line_dedup, mixing, pii, quality
from quarry.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, source string, n_words int, size string, row int, hits int"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == expected(ORACLE_SQL[name], sf_dir)


# chat


CHAT = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_reads_back_what_went_in(spark):
    texts = ["", None, "plain", "\\### Assistant: </turn> ok", "\n</turn>\n", "<next/>", "\\", "\\\\### x\\", "###", "### ", "a\n<next/>\nb", "\\\n</turn>\n"]
    turns = [(1, k, role, t, "x") for k, (role, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "assistant"))]
    turns += [(2, 0, "odd: %<role>\n\\", "x", None), (2, 1, None, "y", None), (3, None, "user", "b", None), (3, 1, "user", "a", None), (3, 1, "user", "a", None)]
    got = {r["conv_id"]: r for r in chat.format_chat(spark.createDataFrame(turns, CHAT)).withColumn("turns", chat.read_chat(F.col("formatted"))).withColumn("lost", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, t or "") for _, _, r, t, _ in turns if _ is not None or True][: len(texts) * 3]
    assert got[1]["lost"] == "".join(t or "" for _, _, r, t, _ in turns[: len(texts) * 3] if r == "assistant")
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("odd: %<role>\n\\", "x"), ("", "y")]
    assert [t["text"] for t in got[3]["turns"]] == ["b", "a", "a"]
    assert got[3]["formatted"] == "### user: b\n<next/>\na\n<next/>\na\n</turn>\n"


def test_chat_of_nothing(spark):
    assert chat.format_chat(spark.createDataFrame([], CHAT)).count() == 0


# lines


def test_recurring_templates_go_and_the_rest_stays(spark):
    docs = [(i, f"own line {'abcdef'[i]} of this text\nServed page {i} of 90 by host\n\nkeep me {'xyzuvw'[i]}") for i in range(6)]
    docs += [(10, None), (11, ""), (12, "copied whole\nsame"), (13, "copied whole\nsame"), (14, "copied whole\nsame")]
    out = {r["row"]["doc_id"]: r for r in line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string").withColumn("lines", F.lit(1))).collect()}
    for i in range(6):
        assert out[i]["text"] == docs[i][1].replace(f"Served page {i} of 90 by host\n", "") and out[i]["n_dropped"] == 1
    assert out[10]["text"] is None and out[11]["text"] == "" and out[11]["n_lines"] == 1
    assert [out[k]["text"] for k in (12, 13, 14)] == ["copied whole\nsame"] * 3
    assert out[0]["row"]["lines"] == 1


def test_odd_white_space_and_long_lines(spark):
    """Leaves go by words, however they are set apart; a long line takes linear time."""
    say = ["the  host served\tus", " the host served us ", "the host served us", "the host served us\r"]
    docs = [(i, f"{say[i % 4]}\nmine {'abcdefgh'[i]}") for i in range(8)]
    docs += [(20, "a" * 300_000 + " 1" * 100_000), (21, "   \n\t\n"), (22, "word " * 60_000), (20, "again another")]
    out = {r["row"]["doc_id"]: r for r in line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(8):
        assert out[i]["text"] == f"mine {'abcdefgh'[i]}"
    assert out[21]["text"] == "   \n\t\n" and out[21]["n_lines"] == 3 and out[22]["n_dropped"] == 0


def test_lines_of_nothing(spark):
    assert line_dedup.drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# decontamination


def test_windows_short_items_and_offsets(spark):
    item = "One two, three FOUR five six seven eight nine ten eleven"
    bench = [("b", item), ("a", "short item"), (None, "nameless thing"), ("c", None), ("d", "!!"), ("a", "short item")]
    docs = [
        (1, "x ONE two three four; five six seven eight nine ten y", "s"),
        (2, "a SHORT -- item? here", "s"),
        (3, None, "s"),
        (4, "", "s"),
        (5, "one two three four five", "s"),
        (6, "nameless thing", "s"),
        (7, "été short itemé", "s"),
        (8, "word " * 60_000 + "short item", "s"),
    ]
    frame = spark.createDataFrame([(*d, 1, "2", 3, 4) for d in docs], DOCS)
    bench = spark.createDataFrame(bench, "item_id string, text string")
    got = {r["row"]["doc_id"]: r for r in decontaminate.find_benchmark(frame, bench).collect()}
    assert {k: r["items"] for k, r in got.items()} == {1: ["b"], 2: ["a"], 3: [], 4: [], 5: [], 6: [], 7: [], 8: ["a"]}
    assert docs[0][1][got[1]["hits"][0]["start"] : got[1]["hits"][0]["end"]] == docs[0][1][2:-2]
    assert docs[1][1][got[2]["hits"][0]["start"] : got[2]["hits"][0]["end"]] == "SHORT -- item"
    assert len(got[6]["hits"]) == 1 and got[3]["n_words"] == 0 and got[8]["n_words"] == 60_002
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 7]


def test_blocks_of_a_large_benchmark_agree(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert rows(QUERIES["op8_decontaminate"](spark, sf_dir).toPandas()) == expected(ORACLE_SQL["op8_decontaminate"], sf_dir)


def test_nothing_to_find(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_benchmark(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.find_benchmark(one, bench).first()["hits"] == []


# personal data


def base_spans(text):
    """The contract's patterns as they stand."""
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            found.append((m.start(), 2, "card", m.end()))
    found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "@", ".", "1", "12", "-", "+", " ", "_", "b.c", "@x.y", "255", "(", ")", "4929348385146306", "%", "é"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        got = [(x["start"], pii.KINDS.index(x["kind"]), x["kind"], x["end"]) for x in pii.find(text) if x["kind"] in pii.KINDS[:4]]
        assert got == base_spans(text), text


def test_added_kinds_need_their_check_or_context():
    kinds = lambda t: [x["kind"] for x in pii.find(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32") == ["iban"] and kinds("GB83 WEST 1234 5698 7654 32") == []
    assert kinds("ssn: 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("call 030 123 4567") == ["tel"] and kinds("030 123 4567") == []


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "@a" * 50_000, "1." * 100_000, "a.b@" * 40_000):
        pii.find(text)


def test_pii_rows_and_redaction(spark):
    docs = spark.createDataFrame([(1, "é a@b.c and 1.2.3.4", 7), (2, None, 7), (3, "", 7), (1, "é a@b.c and 1.2.3.4", 7)], "doc_id long, text string, spans int")
    found = pii.find_pii(docs).withColumn("clean", pii.redact(F.col("row.text"), F.col("spans")))
    assert sorted((r["row"]["doc_id"], r["clean"] or "") for r in found.collect()) == [(1, "é [email] and [ip]")] * 2 + [(2, ""), (3, "")]
    digest = {r["doc_id"]: r for r in pii.pii_digest(docs).collect()}
    assert digest[1]["spans"] == "email:2:7,ip:12:19" and digest[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.pii_digest(docs.limit(0)).count() == 0


# quality


def test_quality_on_held_out_rows(spark):
    got = QUERIES["op9_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows_ = got.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows_) / len(rows_) > 0.93
    assert all(0 <= r["score"] <= 1 for r in rows_)


def test_scores_of_the_table_one_by_one(spark):
    """Each text compressed by itself with either dictionary, and the curve by hand."""
    import zstandard

    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.learn(docs, labels, quality.fold() != 0)
    got = {r["doc_id"]: r["score"] for r in QUERIES["op9_quality"](spark, sf_dir).collect()}
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (m.bad, m.good)]
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        parts = [raw[i : i + 600] for i in range(0, len(raw), 600)]
        if not parts:
            assert got[r["doc_id"]] == m.share
            continue
        bad, good = (sum(len(p.compress(x)) for x in parts) for p in packers)
        n = len(raw) + 20 * len(parts)
        low = math.log(min(bad, good) / n)
        z = m.weights[3] + sum(w * (v - a) / s for w, v, a, s in zip(m.weights, [(bad - good) / n, low, low * low], m.mean, m.scale, strict=False))
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-z)), abs_tol=1e-9)


def test_long_labelled_texts_are_read_whole(spark):
    """What makes a text good may stand anywhere in it."""
    rng = random.Random(9)
    filler = [f"f{k}" for k in range(500)]
    docs = [(k, " ".join(rng.choices(filler, k=4000)) + (" fine words stand here at the end" if k % 2 else " junk junk sells cheap stuff") * 8) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id long, quality int")
    model = quality.learn(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    score = model.scorer().score
    assert score("fine words stand here at the end") > score("junk junk sells cheap stuff")


def test_quality_without_text_or_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "some text", 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.learn(docs, none)).select("score").collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (9, 1), (None, 1)], "doc_id long, quality int")
    assert quality.quality_digest(docs, some).count() == 3
    kept = quality.keep_good(docs, some)
    assert kept.columns == docs.columns
    assert quality.score(docs.limit(0), quality.learn(docs, some)).count() == 0


# mixing


def filled(sizes):
    """Water-filling as the contract tells it: clamp what is above its cap, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets_equal_repeated_clamping(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 4, 7, 12):
        sizes = {f"s{k:02}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(n)} | {None: rng.choice([0, 3, 900])}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in got), sizes


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", None]), 1, "2", 3, 4) for i in range(900)] + [(5000, None, "b", 1, "2", 3, 4)] * 2
    frame = spark.createDataFrame(docs, DOCS)
    out = mixing.mix(frame).collect()
    assert len(out) == len(docs) and all(r["repeats"] <= 3 for r in out)
    taken, target = {}, {}
    for r in out:
        s = r["row"]["source"]
        taken[s], target[s] = taken.get(s, 0) + r["size"] * r["repeats"], r["target"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    assert sorted(mixing.mix(frame).select("row.doc_id", "repeats").collect()) == sorted((r["row"]["doc_id"], r["repeats"]) for r in out)
    assert mixing.mixed(frame).columns == frame.columns
    assert mixing.mix(frame.limit(0)).count() == 0

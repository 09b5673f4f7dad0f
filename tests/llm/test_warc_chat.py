import hashlib
import random

import pytest

from loomgraph.llm import chat, warc
from loomgraph.llm.common import scratch


def test_records_read_back(spark):
    long = "é\r\n\r\nWARC/1.1\r\n\r\n" * 400
    pages = [(5, "u5", long, 0), (3, "http://x/\r\na", long, 0), (4, None, long, 0), (1, "u1", "short", 0), (2, "u2", "short", 0), (6, "u6", None, 0), (7, "u7", "", 0), (None, "n", long, 0), (9, "", "x" * 200_000, 0), (3, "again", long, 0)]
    path = scratch(spark, "w")
    warc.write(warc.resolve(spark.createDataFrame(pages, "page_id long, url string, html string, bytes int")), path, records_per_file=2)
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(pages)
    by = {r["id"]: r for r in rows}
    body = long.encode()
    assert (by["3"]["record_type"], bytes(by["3"]["payload"])) == ("response", body)
    for k in ("4", "5"):
        assert (by[k]["record_type"], by[k]["refers_to"], by[k]["payload"], by[k]["payload_bytes"], by[k]["payload_digest"]) == ("revisit", "3", None, len(body), hashlib.sha256(body).hexdigest())
    assert [by[k]["record_type"] for k in "1267"] == ["response"] * 4 and by["6"]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    assert sum(r["id"] == "3" and r["record_type"] == "response" for r in rows) == 2 and by[None]["record_type"] == "response"
    assert by["5"]["url"] == "u5" and by["9"]["url"] is None


def test_empty_archive(spark):
    path = scratch(spark, "w")
    warc.write(warc.resolve(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert warc.read(spark, path).count() == 0


BITS = ["\\", "</turn>", "</turn>\n", "</part>", "### ", "#", "<", "/", "user: ", ":", "\n", "a", "é", "👍", "$1", "assistant"]


@pytest.mark.parametrize("seed", range(3))
def test_turns_read_back(spark, seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(BITS) for _ in range(r.randrange(12)))
    rows = [(c, t, r.choice(["user", "assistant", "a:b", "### x"]), text(), "x") for c in range(60) for t in range(r.randrange(1, 9))]
    out = chat.parsed(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").repartition(5))).collect()
    assert len(out) == 60
    for o in out:
        want = [x[2:4] for x in rows if x[0] == o["conv_id"]]
        assert [(t["role"], t["text"]) for t in o["turns"]] == want
        assert o["loss_text"] == "".join(b for a, b in want if a == "assistant")


def test_merged_nulls_and_empty(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, None, None, "first")]
    o = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert o["formatted"] == "### : first</turn>\n### user: </part>b</turn>\n### assistant: c</turn>\n"
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0

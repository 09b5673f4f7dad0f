"""Headers that every record must have."""

import gzip
import re
from datetime import UTC, datetime

from loomgraph.llm.warc import parse, read, resolve, write


def test_every_record_has_a_date_and_an_id(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200), (None, "u", "x" * 200), (None, None, None)], "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    write(resolve(pages), path, at=datetime(2024, 3, 1, 12, tzinfo=UTC))
    heads = [h for f in (tmp_path / "warc").glob("*.gz") for h, _ in parse(gzip.open(f))]
    assert len(heads) == 4 and {h["warc-date"] for h in heads} == {"2024-03-01T12:00:00Z"}
    assert len({h["warc-record-id"] for h in heads}) == 4
    assert sum(bool(re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", h["warc-record-id"])) for h in heads) == 2
    back = read(spark, path).collect()
    assert sorted((r.id or "", r.record_type, r.refers_to or "") for r in back) == [("", "response", ""), ("", "response", ""), ("1", "response", ""), ("2", "revisit", "1")]

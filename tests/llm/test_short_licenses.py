"""License templates of fewer words than a shingle has are found, by the query's own list too."""

import re

from tabulith.llm import licenses, queries
from tests.conftest import SMALL
from tests.llm.test_operators import ODD, docs


def test_short_templates(spark):
    rows = [*ODD, (60, "a b. All rights\n reserved! c all rights reserved"), (61, "all rights are reserved"), (62, "x SPDX-License-Identifier: MIT"), (None, "All rights reserved"), (63, "overall rights reserved"), (64, "one")]
    given = {"arr": "All rights reserved.", "spdx": "SPDX-License-Identifier: MIT", "one": "one", "none": "...", "mit": "Released under the MIT License."}
    got = sorted(((r.doc_id or 0, r.template_id, r.containment, r.word_start) for r in licenses.scan_licenses(spark, docs(spark, rows), given).collect()))
    one = [(i or 0, "one", 1.0, 0) for i, t in rows if t and t.startswith("one")]
    assert got == sorted([*one, (60, "arr", 1.0, 2), (62, "spdx", 1.0, 1), (0, "arr", 1.0, 0)])
    alone = licenses.scan_licenses(spark, docs(spark, rows), {"arr": given["arr"]})
    assert sorted((r.doc_id or 0) for r in alone.collect()) == [0, 60]
    plan = alone._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_finds_bare_notice(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = sorted(r.doc_id for r in rows if " all rights reserved " in f" {re.sub('[^a-z0-9]+', ' ', r.text.lower()).strip()} ")
    got = queries.op6_license_scan(spark, SMALL).where("template_id = 'all-rights-reserved-notice'")
    assert want and sorted(r.doc_id for r in got.collect()) == want

"""A policy that decides every value by itself takes no neighbours, and gives what the path gives."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators.timestamps import choose_readings, interpretations, parse_values, viterbi
from paperloom.plans.core_problems import p3_found, p3_normalised


@pytest.mark.parametrize("policy", ["day_first", "month_first"])
def test_the_rule_chooses_what_the_path_would(spark, policy):
    r = random.Random(3)
    texts = ["no date", "", "2025-03-04", "29/02/00", "02/29/00", "04/04/99", "4 March 99"]
    texts += [f"{r.randrange(1, 32)}/{r.randrange(1, 32)}/{r.choice(('25', '99', '00', '1999', '2025'))}" for _ in range(200)]
    parsed = parse_values(spark.createDataFrame(list(enumerate(texts)), "id int, v string"), "v").withColumn("src", F.lit("s"))
    chosen = choose_readings(parsed, "src", ["id"], policy)
    got = {x.id: x.reading for x in chosen.collect()}
    readable = [i for i, t in enumerate(texts) if interpretations(t)]
    assert [got[i] for i in readable] == viterbi([interpretations(texts[i]) for i in readable], policy)
    assert all(got[i] is None for i in set(got) - set(readable)) and len(got) == len(texts)


def test_normalised_dates_need_no_order_of_loading(spark, tmp_path):
    for tbl, fields in (("invoices", ("issue_date", "due_date")), ("contracts", ("effective_date",)), ("forms", ("form_date",))):
        rows = [("t1", *["03/04/2025 23:30"] * len(fields), "America/New_York"), ("t2", *["04/25/25"] * len(fields), None), (None, *["none"] * len(fields), None)]
        spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("trace_id", *fields, "office_tz"))).write.parquet(f"{tmp_path}/{tbl}.parquet")
    got = {(x.tbl, x.field, x.trace_id): (str(x.written_date), x.utc_instant, x.kind) for x in p3_normalised(spark, str(tmp_path)).collect()}
    assert len(got) == 12
    for (tbl, field), _ in itertools.groupby(sorted(got, key=str), key=lambda k: k[:2]):
        assert got[tbl, field, "t1"] == ("2025-04-03", "2025-04-04 03:30:00", "instant")
        assert got[tbl, field, "t2"] == ("2025-04-25", None, "date") and got[tbl, field, None] == ("None", None, "unreadable")
    assert {x.trace_id for x in p3_found(spark, str(tmp_path)).collect()} == {"t1"}

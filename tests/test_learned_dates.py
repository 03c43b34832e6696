"""Neighbours decide where the text leaves freedom."""

import datetime as dt

from paperloom.operators.timestamps import DAY_FIRST, LAST_CENTURY, MONTH_FIRST, interpretations, normalise_timestamps, viterbi


def test_two_digits_of_a_year_may_mean_two_centuries():
    assert [f for f, _ in interpretations("03/04/99")] == [DAY_FIRST, MONTH_FIRST, DAY_FIRST + LAST_CENTURY, MONTH_FIRST + LAST_CENTURY]
    days = lambda *texts: [interpretations(t) for t in texts]
    read = lambda chain, policy: [c[i][1] for c, i in zip(chain, viterbi(chain, policy))]
    day = lambda y, m, d: (dt.date(y, m, d) - dt.date(1970, 1, 1)).days
    old = days("1998-02-01", "13/02/99", "1999-03-01", "2000-01-05")
    assert read(old, "learn")[1] == day(1999, 2, 13) and read(old, "day_first")[1] == day(2099, 2, 13)
    assert read(days("2024-02-01", "13/02/24", "2024-03-01"), "learn")[1] == day(2024, 2, 13)


def test_a_day_written_alike_either_way_is_no_switch():
    chain = [interpretations(t) for t in ("25/03/2025", "04/04/2025", "05/04/2025", "06/04/2025", "26/04/2025")]
    us = [interpretations(t) for t in ("03/25/2025", "04/04/2025", "04/05/2025", "04/06/2025", "04/26/2025")]
    assert [c[i][0] for c, i in zip(chain, viterbi(chain, "learn"))][2:4] == [DAY_FIRST, DAY_FIRST]
    assert [c[i][0] for c, i in zip(us, viterbi(us, "learn"))][2:4] == [MONTH_FIRST, MONTH_FIRST]


def test_planted_truth_is_found_by_the_path(spark):
    rows = []
    for s in range(12):
        for i in range(90):
            day = dt.date(2025, 1, 2) + dt.timedelta(days=4 * i)
            rows.append((s, i, day.strftime("%m/%d/%Y" if s % 2 else "%d/%m/%Y"), day))
    df = spark.createDataFrame(rows, "src int, id int, v string, truth date")
    got = normalise_timestamps(df, "v", "src", ["id"], policy="learn")
    right = got.selectExpr("avg(if(written_date = truth, 1, 0)) AS r").first().r
    by_rule = normalise_timestamps(df, "v", "src", ["id"]).selectExpr("avg(if(written_date = truth, 1, 0)) AS r").first().r
    assert right > 0.995 and by_rule < 0.9

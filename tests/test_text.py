"""Message contexts, dates, answers and blocks on small inputs."""

import pytest
from pyspark.sql import functions as F

from mailloom.functions import text as X

CONTEXTS = [
    (None, "", [], 0, None),
    ("", "", [], 0, None),
    ("Hello.\n--\nName Here\n", "Hello.", [], 0, "Name Here"),
    ("> a\n> > b\n\nYes.\n", "Yes.", [1, 2], 0, None),
    ("New.\n\n\nMore.\n\nOn Mon, Mar 3, 2014, A. Writer <a@x.org> wrote:\n> a\n> > b\n> c\n-- \nA. Writer\nOf X\n", "New.\n\nMore.", [1, 2, 1], 1, "A. Writer\nOf X"),
    ("Wait\n\nOn Wed, Mar 5, 2014 at 7 PM, Some One <\none@x.org> wrote:\n> q\n", "Wait", [1], 1, None),
    ("On time\n\nwrote:\n", "On time\n\nwrote:", [], 0, None),
]


@pytest.mark.parametrize(("body", "own", "depths", "attributions", "signature"), CONTEXTS)
def test_context_of_a_body(body, own, depths, attributions, signature):
    c = X._context(body)
    assert (c[0], [s["depth"] for s in c[1]], len(c[2]), c[3]) == (own, depths, attributions, signature)


def test_context_column(spark):
    rows = spark.createDataFrame([(b,) for b, *_ in CONTEXTS], "body string").select(X.message_context("body").alias("c")).collect()
    assert [(r.c.new_content, [s.depth for s in r.c.quoted_segments], r.c.signature) for r in rows] == [(o, d, s) for _, o, d, _, s in CONTEXTS]


def test_mail_dates(spark):
    given = {"Mon, 3 Mar 2014 10:00:00 -0500 (EST)": "2014-03-03 15:00:00", "3 Mar 2014 10:00 GMT": "2014-03-03 10:00:00", "3 Mar 2014 10:00:00": "2014-03-03 10:00:00", "soon": None, "": None}
    df = spark.createDataFrame([(k,) for k in given], "d string").select("d", F.date_format(X.mail_date(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("t"))
    assert {r.d: r.t for r in df.collect()} == given

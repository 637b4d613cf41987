"""A host's wrapper comes from all of its pages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import wrappers

FORM = "page_id long, url string, html string"


def bare(i, tag, more="", mark=""):
    """A page without article or main."""
    return f"<html><body><div class='top'>The site</div><div class='tag'>{tag}</div><p{mark}>Own words {i}</p>{more}</body></html>"


def texts(rows):
    return {r.page_id: r.text for r in wrappers.extract(rows).collect()}


def hosts(count, pages):
    """Per host one page whose tag differs."""
    rows, want = [], {}
    for h in range(count):
        for i in range(pages):
            at, tag = h * pages + i, "Once" if i == h % pages else "Usual"
            rows.append((at, f"http://h{h}.org/{i}", bare(at, tag)))
            want[at] = f"{tag} Own words {at}"
    return rows, want


@pytest.mark.parametrize("group", [256, 4])
def test_every_page_counts(spark, monkeypatch, group):
    monkeypatch.setattr(wrappers, "GROUP", group)
    monkeypatch.setattr(wrappers, "GROUPS", 3)
    rows, want = hosts(6, 45)
    # Copies of a page are one page: two different ones leave every text.
    for i in range(30):
        rows.append((5000 + i, "http://copies.org/x", bare(i % 2, "Same")))
        want[5000 + i] = f"The site Same Own words {i % 2}"
    # Without a host, and a text that two pages share only.
    for i in range(12):
        more = f"<ul><li>Shared {i % 2}</li></ul>" if i < 4 else f"<blockquote>Alone {i}</blockquote>" if i == 5 else ""
        rows.append((6000 + i, None, bare(i, "Tag", more)))
        want[6000 + i] = f"Own words {i}" + (f" Shared {i % 2}" if i < 4 else f" Alone {i}" if i == 5 else "")
    frame = spark.createDataFrame(rows, FORM)
    assert texts(frame.repartition(3)) == want
    assert texts(frame.orderBy(F.desc("page_id")).coalesce(1)) == want


def test_pages_are_counted(spark):
    rows, _ = hosts(1, 40)
    rows += [(900 + i, r[1], r[2]) for i, r in enumerate(rows)]
    (got,) = wrappers.wrappers(spark.createDataFrame(rows, FORM)).collect()
    assert got.n == 40
    kept = json.loads(got.site)
    assert kept[3][0][0] == "body" and kept[3][0][3] == [["div.top", False, False, [["#", False, False, "The site", 40]]]]


def test_wrapper_stays_small_with_a_mark_for_each_page():
    pick = random.Random(1)
    pages = [bare(i, "Usual", "".join(f"<section id='s{pick.random()}'><b>x</b><h2>Word {i} {k}</h2></section>" for k in range(9))) for i in range(900)]
    known = wrappers.infer(pages)
    assert wrappers.size(known) <= wrappers.MOST
    for i in (0, 450, 899):
        want = " ".join([f"Own words {i}", *(f"x Word {i} {k}" for k in range(9))])
        assert wrappers.main_text(pages[i], known, True).replace("The site ", "").replace("Usual ", "") == want


def test_a_varying_text_beside_a_constant_one_stays():
    pages = [f"<body><div>Home <br> Words {i}</div><div class='x'>{'long ' * 40}</div></body>" for i in range(5)]
    known = wrappers.infer(pages)
    assert wrappers.main_text(pages[2], known, True) == "Words 2"

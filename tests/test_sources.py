"""Uploads, named cohorts and export templates."""

import os

import pytest

from lifegrid.errors import NotFoundError, UserInputError
from lifegrid.operators import cohort, cox
from lifegrid.sources import bundled, exports, readers

ROWS = [{"Model": "cox_ph", "C": 0.7125}, {"Model": "a|b_%", "C": None}]


@pytest.mark.parametrize(("name", "markdown", "heading", "place"), [("default", "**Table 1. Model performance summary.**", "Notes", "[htbp]"), ("nejm", "*Table 1. Model discrimination summary.*", "Notes", "[t]"), ("lancet", "Table 1. Model discrimination summary", "Comments", "[t]"), ("jco", "**Table 1. Model performance summary.**", "Footnotes", "[htbp]")])
def test_templates(name, markdown, heading, place):
    text = exports.to_markdown(ROWS, template=name, notes=["one\nline", " "])
    assert text.startswith(markdown + "\n\n| Model | C |") and text.endswith(f"{heading}:\n\n- one line\n")
    tex = exports.to_latex(ROWS, template=name, notes=["n"])
    assert rf"\begin{{table}}{place}" in tex and rf"\textit{{{heading}:}} n" in tex and tex.count(r"\\") == 3
    assert exports.to_csv(ROWS, caption="c", notes=["n"], template=name).startswith(f"# c\n# {heading}:\n# - n\nModel,C\n")
    assert exports.to_docx(ROWS, template=name)[:2] == b"PK"


def test_unknown_template():
    with pytest.raises(UserInputError):
        exports.to_markdown(ROWS, template="none")


def test_uploads(spark):
    df = readers.load_bytes(spark, "a;b\n1;é\n".encode("latin-1"), "../x.CSV")
    assert df.columns == ["a", "b"] and df.first().b == "é"
    for content, name in ((b" ", "x.csv"), (b"a", "x.doc")):
        with pytest.raises(UserInputError):
            readers.load_bytes(spark, content, name)


def test_named_cohorts(spark, tmp_path):
    (tmp_path / "gbsg2.csv").write_text("rfs_days,rfs_event,age,estrec,horTh,menostat,pnodes,progrec,tgrade\n5,1,4,3,no,Post,1,2,II\n")
    with pytest.raises(UserInputError, match="tsize"):
        bundled.load(spark, "gbsg2", str(tmp_path))
    for name, folder in (("none", str(tmp_path)), ("tcga_luad", str(tmp_path)), ("gbsg2", None)):
        if folder or not os.environ.get("LIFEGRID_COHORTS"):
            with pytest.raises(NotFoundError):
                bundled.load(spark, name, folder)


@pytest.mark.skipif(not os.environ.get("LIFEGRID_COHORTS"), reason="no folder of cohorts")
def test_published_hazard_ratio(spark):
    """The hazard ratio of a positive node in the published cohort."""
    c = cohort.build(bundled.load(spark, "gbsg2"), "rfs_days", "rfs_event", 1, ["pnodes"])
    (row,) = cox.fit(c.df, ["pnodes"]).table()
    assert row["hazard_ratio"] == pytest.approx(1.060354, rel=1e-6) and row["beta"] == pytest.approx(0.05860287, rel=1e-6) and row["p_value"] == pytest.approx(3.488721e-18, rel=1e-6)

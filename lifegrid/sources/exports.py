"""Bounded result tables as CSV, Markdown, LaTeX, DOCX and XLSX text or bytes."""

from __future__ import annotations

import csv
import io
import math
import zipfile
from dataclasses import dataclass
from xml.sax.saxutils import escape

from ..errors import DependencyError, UserInputError


@dataclass(frozen=True)
class Template:
    """How a journal wants its tables: the caption's emphasis (Markdown marks; bold and italic in documents), the notes' heading, LaTeX float
    position and size, and the caption of a table that has none."""

    mark: str
    bold: bool
    italic: bool
    notes: str
    position: str
    size: str
    caption: str


# Results must look as asked for.
TEMPLATES = {
    "default": Template("**", True, False, "Notes", "htbp", r"\small", "Table 1. Model performance summary."),
    "nejm": Template("*", False, True, "Notes", "t", r"\footnotesize", "Table 1. Model discrimination summary."),
    "lancet": Template("", False, False, "Comments", "t", r"\small", "Table 1. Model discrimination summary"),
    "jco": Template("**", True, False, "Footnotes", "htbp", r"\small", "Table 1. Model performance summary."),
}


def template_of(name: str) -> Template:
    if name not in TEMPLATES:
        raise UserInputError(f"unknown template {name}; one of {', '.join(TEMPLATES)}")
    return TEMPLATES[name]


def flat(text: str) -> str:
    return " ".join(text.split())


def cell(value: object, digits: int = 4) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return ""
    return f"{value:.{digits}g}" if isinstance(value, float) else str(value)


def _columns(rows: list[dict], columns: list[str] | None) -> list[str]:
    return columns or list(dict.fromkeys(k for r in rows for k in r))


def plain_text(s: str) -> str:
    """Text that a spreadsheet would take for a formula, blanks before it or not, with a leading apostrophe."""
    risky = s[:1] in ("\t", "\r") or s.lstrip()[:1] in ("=", "+", "-", "@")
    return "'" + s if risky and s.strip() and not _number(s) else s


def to_csv(rows: list[dict], columns: list[str] | None = None, caption: str = "", notes: list[str] = (), template: str = "default") -> str:
    """Caption and notes as # lines; text that a spreadsheet would take for a formula gets a leading apostrophe."""
    out, notes = io.StringIO(), [flat(n) for n in notes if n.strip()]
    for line in [*([flat(caption)] if caption.strip() else []), *([template_of(template).notes + ":"] if notes else []), *(f"- {n}" for n in notes)]:
        out.write(f"# {line}\n")
    cols, w = _columns(rows, columns), csv.writer(out, lineterminator="\n")
    w.writerow([plain_text(c) for c in cols])
    w.writerows([plain_text(cell(r.get(c), 10)) for c in cols] for r in rows)
    return out.getvalue()


def _number(s: str) -> bool:
    try:
        float(s)
        return True
    except ValueError:
        return False


def to_markdown(rows: list[dict], columns: list[str] | None = None, caption: str = "", notes: list[str] = (), template: str = "default") -> str:
    cols = _columns(rows, columns)
    line = lambda xs: "| " + " | ".join(plain_text(x).replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    body = [line(cols), "| " + " | ".join(["---"] * len(cols)) + " |", *[line([cell(r.get(c)) for c in cols]) for r in rows]]
    how, notes = template_of(template), [flat(n) for n in notes if n.strip()]
    parts = [how.mark + (flat(caption) or how.caption) + how.mark, "\n".join(body)]
    if notes:
        parts += [how.notes + ":", "\n".join(f"- {n}" for n in notes)]
    return "\n\n".join(parts) + "\n"


# How LaTeX writes its own characters.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex(text: str) -> str:
    return "".join(LATEX.get(c, c) for c in text)


def to_latex(rows: list[dict], columns: list[str] | None = None, caption: str = "", notes: list[str] = (), template: str = "default") -> str:
    cols, how = _columns(rows, columns), template_of(template)
    line = lambda xs: " & ".join(latex(flat(x)) for x in xs) + r" \\"
    body = [line(cols), r"\midrule", *[line([cell(r.get(c)) for c in cols]) for r in rows]]
    head = [rf"\begin{{table}}[{how.position}]", r"\centering", how.size, rf"\caption{{{latex(flat(caption) or how.caption)}}}", rf"\begin{{tabular}}{{{'l' * len(cols)}}}", r"\toprule"]
    tail, said = [r"\bottomrule", r"\end{tabular}"], " ".join(latex(flat(n)) for n in notes if n.strip())
    if said:
        tail += [r"\par\vspace{0.4em}", rf"\parbox{{0.95\linewidth}}{{\footnotesize\textit{{{how.notes}:}} {said}}}"]
    return "\n".join([*head, *body, *tail, r"\end{table}"]) + "\n"


def to_docx(rows: list[dict], columns: list[str] | None = None, caption: str = "", notes: list[str] = (), template: str = "default") -> bytes:
    """A minimal Office Open XML document with one table."""
    cols, how, notes = _columns(rows, columns), template_of(template), [flat(n) for n in notes if n.strip()]
    look = lambda bold, italic: f"<w:rPr>{'<w:b/>' * bold}{'<w:i/>' * italic}</w:rPr>" if bold or italic else ""
    run = lambda s, bold=False, italic=False: f"<w:p><w:r>{look(bold, italic)}<w:t xml:space=\"preserve\">{escape(s)}</w:t></w:r></w:p>"
    tr = lambda xs, bold=False: "<w:tr>" + "".join(f"<w:tc>{run(x, bold)}</w:tc>" for x in xs) + "</w:tr>"
    edge = "".join(f'<w:{s} w:val="single" w:sz="4"/>' for s in ("top", "bottom", "insideH"))
    table = f"<w:tbl><w:tblPr><w:tblBorders>{edge}</w:tblBorders></w:tblPr>" + tr(cols, True) + "".join(tr([cell(r.get(c)) for c in cols]) for r in rows) + "</w:tbl>"
    body = run(flat(caption) or how.caption, how.bold, how.italic) + table + (run(how.notes + ":", True) if notes else "") + "".join(run(n) for n in notes) + "<w:p/>"
    ns = "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="rId1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{ns}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def to_xlsx(rows: list[dict], columns: list[str] | None = None, caption: str = "", notes: list[str] = (), template: str = "default") -> bytes:
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise DependencyError("XLSX export needs openpyxl") from e
    book, cols = Workbook(), _columns(rows, columns)
    for line in [[caption]] * bool(caption) + [cols] + [[r.get(c) for c in cols] for r in rows] + [[template_of(template).notes]] * bool(notes) + [[n] for n in notes]:
        book.active.append([plain_text(x) if isinstance(x, str) else x for x in line])
    out = io.BytesIO()
    book.save(out)
    return out.getvalue()

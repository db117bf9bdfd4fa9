"""Placed strings as PDF files of fixed-pitch text."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame

#: An upright page in points, and the share of its size that a fixed-pitch character takes.
WIDTH, HEIGHT, PITCH = 595, 842, 0.6


def _string(text: str) -> bytes:
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)") + b")"


def rendered(pages: list[list[tuple[float, float, float, str]]]) -> bytes:
    """A file of pages of strings (x, y, size, text), the base line y up from the bottom; contents are compressed."""
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"
    kids = b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), kids, WIDTH, HEIGHT), font]
    for i, strings in enumerate(pages):
        body = b"BT\n" + b"".join(b"/F1 %.2f Tf 1 0 0 1 %.2f %.2f Tm %s Tj\n" % (size, x, y, _string(text)) for x, y, size, text in strings) + b"ET\n"
        packed = zlib.compress(body)
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed)]
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


def files(strings: DataFrame) -> DataFrame:
    """(path, content): a file for each path of strings (path, page, x, y, size, text); a file's strings meet in one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page", "y", "x"], ascending=[True, False, True], kind="stable")
        pages = [list(g[["x", "y", "size", "text"]].itertuples(index=False, name=None)) for _, g in rows.groupby("page")]
        return pd.DataFrame({"path": [key[0]], "content": [rendered(pages)]})

    return strings.select("path", "page", "x", "y", "size", "text").groupBy("path").applyInPandas(run, "path string, content binary")

"""Source text: token classes and initialisers as native functions; what a module holds as an Arrow function over Python's own parser."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

#: A comment, a string, a number, a name, or any other mark.
TOKEN = r"""(#[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[0-9][0-9A-Za-z_.]*|[A-Za-z_][0-9A-Za-z_]*|[^\s0-9A-Za-z_])"""
WINDOW, PIECE = 12, 1 << 18


def _rows(**fields: DataType) -> ArrayType:
    return ArrayType(StructType([StructField(name, kind) for name, kind in fields.items()]))


MODULE = StructType([StructField("parsed", BooleanType()), StructField("quiet", _rows(start=IntegerType(), stop=IntegerType())), StructField("imports", _rows(line=IntegerType(), target=StringType())), StructField("bindings", _rows(name=StringType(), line=IntegerType()))])


def token_classes(line: Column, keywords: list[str] | None = None) -> Column:
    """The tokens of a line with names as ID and strings and numbers as LIT; comments go, keywords and marks stay."""
    tokens = F.filter(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(1)), lambda t: ~t.startswith("#"))
    kept = F.array(*[F.lit(k) for k in keywords]) if keywords else F.array().cast("array<string>")
    return F.transform(tokens, lambda t: F.when(F.array_contains(kept, t), t).when(t.rlike("^[A-Za-z_]"), F.lit("ID")).when(t.rlike("""^["'0-9]"""), F.lit("LIT")).otherwise(t))


def initialiser_text(text: Column, line: Column) -> Column:
    """What stands behind the first = outside brackets of the statement on a line, without comments and white space, its tokens one blank apart;
    null if there is none or a bracket stays open for WINDOW lines. A fold over the window's tokens, line ends among them."""
    window = F.array_join(F.slice(F.split(text, "\n"), F.greatest(line, F.lit(1)), F.lit(WINDOW)), "\n")
    tokens = F.filter(F.regexp_extract_all(F.concat(window, F.lit("\n")), F.lit(TOKEN.replace(r"[^\s0-9", r"\n|[^\s0-9")), F.lit(1)), lambda t: ~t.startswith("#"))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("phase"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        """phase: 0 before the sign, 1 behind it, 2 after the end."""
        ends = (t == "\n") & (s["open"] == 0)
        phase = F.when((s["phase"] == 2) | ends, 2).when((s["phase"] == 0) & (t == "=") & (s["open"] == 0), 1).otherwise(s["phase"])
        open_ = s["open"] + F.when(s["phase"] == 2, 0).when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)
        out = F.when((s["phase"] == 1) & (t != "\n"), F.concat(s["out"], F.array(t))).otherwise(s["out"])
        return F.struct(open_.cast("int").alias("open"), phase.cast("int").alias("phase"), out.alias("out"))

    done = F.aggregate(tokens, start, step)
    return F.when((line > 0) & (done["phase"] == 2) & (F.size(done["out"]) > 0), F.array_join(done["out"], " "))


class _Outline(ast.NodeVisitor):
    """Intervals of lines that an import of the module leaves alone, its imports wherever they stand, and the names that it binds at its top."""

    def __init__(self) -> None:
        self.quiet: list[tuple[int, int]] = []
        self.imports: list[tuple[int, str]] = []
        self.bindings: list[tuple[str, int]] = []
        self.inner = 0

    def _silent(self, first: ast.stmt, last: ast.stmt) -> None:
        self.quiet.append((first.lineno, last.end_lineno or last.lineno))

    def _nested(self, node: ast.AST) -> None:
        self.inner += 1
        self.generic_visit(node)
        self.inner -= 1

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self._silent(node.body[0], node.body[-1])
        self._nested(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._nested(node)

    def visit_If(self, node: ast.If) -> None:
        if re.fullmatch(r"(\w+\.)*TYPE_CHECKING", ast.unparse(node.test)):
            self._silent(node.body[0], node.body[-1])
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self.imports += [(node.lineno, name.name) for name in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.imports.append((node.lineno, "." * node.level + (node.module or "")))

    def visit_Assign(self, node: ast.Assign) -> None:
        self._bound(node.targets, node.lineno)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._bound([node.target] if node.value else [], node.lineno)

    def _bound(self, targets: list[ast.expr], line: int) -> None:
        if not self.inner:
            self.bindings += [(t.id, line) for t in targets if isinstance(t, ast.Name)]


def _outline_rows(texts: list[str | None]) -> pa.Array:
    rows = []
    for t in texts:
        outline, parsed = _Outline(), True
        try:
            outline.visit(ast.parse(t or ""))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            outline, parsed = _Outline(), False
        pack = lambda names, xs: [dict(zip(names, x, strict=True)) for x in xs]
        rows.append({"parsed": parsed, "quiet": pack(("start", "stop"), outline.quiet), "imports": pack(("line", "target"), outline.imports), "bindings": pack(("name", "line"), outline.bindings)})
    return pa.array(rows, to_arrow_type(MODULE))


@F.arrow_udf(MODULE)
def module_outline(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """parsed, quiet (intervals of lines), imports and bindings of a Python file; a text that can't be parsed has none of them.

    A batch is parsed in pieces of about PIECE bytes, so what a worker holds of trees and rows doesn't follow the batch."""
    for batch in text:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)) // PIECE
        borders = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(batch)]
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            if a < b:
                yield _outline_rows(batch.slice(a, b - a).to_pylist())

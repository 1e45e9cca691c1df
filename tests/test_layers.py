import ast
import pathlib


def test_nothing_else_imports_the_training_data_operators():
    root = pathlib.Path(__file__).parent.parent
    for f in (root / "kinweave").rglob("*.py"):
        if "llm" not in f.parts:
            names = [n.module or "" if isinstance(n, ast.ImportFrom) else a.name for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names]
            assert not any("llm" in x.split(".") for x in names), f

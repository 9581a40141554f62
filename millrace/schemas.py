"""Record schemas by name: module-level lists of fields, here and in modules of the user's."""

from __future__ import annotations

import importlib.util
import sys
from pathlib import Path
from types import ModuleType

from .operators.extraction import Field

GENERIC_ROW = [Field("row_data", "string", True)]
INVOICE_LINE = [Field("item", "string", True), Field("quantity", "int"), Field("unit_price", "float"), Field("currency", "string")]


def schemas_in(module: ModuleType) -> dict[str, list[Field]]:
    """Names of the module's own lists of at least one field; private names are left out."""
    found = {name: value for name, value in vars(module).items() if not name.startswith("_") and isinstance(value, list)}
    return {name.lower(): value for name, value in found.items() if value and all(isinstance(f, Field) for f in value)}


def discover(folder: str | None = None) -> tuple[dict[str, list[Field]], dict[str, str]]:
    """Schemas by name in order, and what went wrong by file: one broken file does not hide the others."""
    found, problems = schemas_in(sys.modules[__name__]), {}
    for path in sorted(Path(folder).glob("*.py")) if folder else []:
        spec = importlib.util.spec_from_file_location(f"user_schemas_{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        try:
            spec.loader.exec_module(module)
        except Exception as e:  # whatever a user's module may raise
            problems[path.name] = f"{type(e).__name__}: {e}"
            continue
        found |= schemas_in(module)
    return dict(sorted(found.items())), problems

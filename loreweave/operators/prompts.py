"""Prompts from templates: variables in double braces, a version in a leading comment, and the prompt's digest."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreweave.functions import text as X

# The forms of a variable and of the version, and the variables that a template must have.
_VARIABLE = re.compile(r"\{\{\s*([A-Za-z][A-Za-z0-9.]*)\s*\}\}")
_VERSION = re.compile(r"\A<!--\s*prompt-version:\s*([^>\s][^>]*)\s*-->(?:\r\n|[\n\r\v\f\x85  ])?")
REQUIRED = ("document.metadata", "evidence")


@dataclass(frozen=True)
class Template:
    """A template cut at its variables: ``parts`` has texts at even and names at odd places."""

    version: str
    digest: str
    parts: tuple[str, ...]

    @property
    def identifier(self) -> str:
        return f"document-analysis@{self.version}"

    def rendered(self, values: dict[str, Column]) -> Column:
        """The prompt of each row; a ValueError for a variable that has no column."""
        unknown = set(self.parts[1::2]) - set(values)
        if unknown:
            raise ValueError(f"unknown variables: {sorted(unknown)}")
        return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(self.parts)])


def template(content: str) -> Template:
    """A template's text; a ValueError if it is blank or lacks a required variable. Without a version it has its digest's."""
    if not content or not content.strip():
        raise ValueError("blank template")
    found = _VERSION.search(content)
    digest = hashlib.sha256(content.encode()).hexdigest()
    parts = tuple(_VARIABLE.split(content[found.end() :] if found else content))
    if not set(REQUIRED) <= set(parts[1::2]):
        raise ValueError(f"a template has {' and '.join(REQUIRED)}")
    return Template(found[1].strip() if found else f"sha256:{digest}", digest, parts)


def prompt_digest(made: Template, prompt: Column) -> Column:
    """What tells one prompt from another: its template and its text."""
    return X.sha256(X.length_prefixed(F.lit(made.identifier), prompt))

"""Path predicates: globs, ignore rules, language and role of a file, as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language.
LANGUAGE_OF = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "cpp": "cpp", "cc": "cpp",
    "cxx": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp", "rs": "rust", "go": "go", "md": "markdown", "rst": "markdown", "txt": "text",
    "njk": "template", "hbs": "template", "mustache": "template", "ejs": "template", "pug": "template", "liquid": "template", "erb": "template",
    "twig": "template", "j2": "template", "jinja": "template",
}
# Name rules.
README_NAME = r"readme|architecture|design"
TEST_NAME = r"^test_.*|.*_test\.[^.]+$|.*\.test\.[^.]+$|.*\.spec\.[^.]+$|.*_spec\.[^.]+$"
CONFIG_NAME = r"config|settings|options|\.env|dockerfile|makefile|package\.json|requirements\.txt|setup\.py|pyproject\.toml|cargo\.toml|go\.mod|pom\.xml|\.(json|ya?ml|toml|ini|cfg)$"
DOC_PART = r"(^|/)(doc|docs|documentation|manual|guide|tutorial)/|\.(md|rst|txt)$"
EXAMPLE_PATH = r"example|demo|sample|tutorial"
ENTRY_NAME = r"(^|/)(main\.py|__main__\.py|app\.py|server\.py|index\.py|main\.js|index\.js|app\.js|server\.js|index\.ts|main\.ts|main\.go|main\.rs|lib\.rs|mod\.rs)$"
EXAMPLES_PART = r"(^|/)(examples?|demos?|samples?|tutorials?|tests?|specs?|benchmarks?)/"
# Names of generated files, directories that are left out.
GENERATED_NAME = r"\.generated\.\w+$|\.gen\.\w+$|_pb2\.py$|_pb2_grpc\.py$|\.pb\.go$|\.min\.\w+$|\.bundle\.\w+$|\.chunk\.\w+$|lock\.json$|yarn\.lock$"
EXCLUDED_DIRECTORY = r"(^|/)(build|dist|out|target|bin|obj|node_modules|vendor|pods|__pycache__|venv|env|site-packages|coverage|htmlcov)/"


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob: ``**/`` any directories, ``**`` anything, ``*`` and ``?`` within a name; a bare name matches at any depth."""
    p = pattern.lstrip("/")
    if "/" not in p.rstrip("/"):
        p = "**/" + p
    if p.endswith("/"):
        p += "**"
    out, i = [], 0
    while i < len(p):
        if p.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(p[i]) or re.escape(p[i]))
            i += 1
    return "^" + "".join(out) + "$"


def any_glob(patterns: list[str]) -> str:
    """One alternation of several globs; matches nothing for no patterns."""
    return "|".join(f"(?:{glob_regex(p)})" for p in patterns) or r"[^\s\S]"


def included(path: Column, size: Column, include: list[str], exclude: list[str], most: int = 50 << 20) -> Column:
    """Size within bounds, no exclusion matches, and an inclusion matches if there are any. Null paths are left out."""
    keep = (size <= most) & ~path.rlike(any_glob(exclude))
    return F.coalesce(keep & path.rlike(any_glob(include)) if include else keep, F.lit(False))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore-file match: a directory pattern matches any component but the last, a bare one any component, one with a slash the whole path."""
    hit = F.lit(False)
    for p in patterns:
        p = p.strip()
        if not p or p.startswith(("#", "!")):
            continue
        if "/" in p.rstrip("/"):
            hit = hit | path.rlike(glob_regex(p.rstrip("/") + ("/**" if p.endswith("/") else "")))
        else:
            part = glob_regex(p.rstrip("/"))[1:-1].removeprefix("(?:[^/]+/)*")
            hit = hit | path.rlike(f"(^|/){part}/" if p.endswith("/") else f"(^|/){part}(/|$)")
    return hit


def matches(path: Column, pattern: str, mode: str) -> Column:
    """EXACT, SUFFIX, GLOB or REGEX match; an invalid regex matches nothing."""
    if mode == "EXACT":
        return path == pattern
    if mode == "SUFFIX":
        return path.endswith(pattern)
    if mode == "GLOB":
        return path.rlike(glob_regex(pattern))
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return path.rlike(pattern)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """Language by extension, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.try_element_at(table, extension(path))


def file_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)$", 1))


def category(path: Column) -> Column:
    """config, entry, examples or general; the first that matches."""
    p = F.lower(path)
    return (
        F.when(file_name(path).rlike(r"\.(json|ya?ml|toml|ini|cfg|conf)$|^(requirements\.txt|setup\.py|makefile|dockerfile)$"), "config")
        .when(p.rlike(ENTRY_NAME), "entry").when(p.rlike(EXAMPLES_PART), "examples").otherwise("general")
    )


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")).cast("int")


def path_score(d: Column) -> Column:
    """1, 0.8, 0.6 for the first three levels, then 2/depth."""
    return F.when(d <= 1, 1.0).when(d <= 2, 0.8).when(d <= 3, 0.6).otherwise(2.0 / d)

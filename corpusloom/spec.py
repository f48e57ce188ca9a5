"""Export settings as dataclasses, with the checks that make bad ones fail early."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column

# The default exclude globs.
DEFAULT_EXCLUDE = (
    "**/node_modules/**",
    "**/.git/**",
    "**/dist/**",
    "**/build/**",
    "**/*.lock",
    "**/*.png",
    "**/*.jpg",
    "**/*.svg",
    "**/*.min.*",
)

# Default templates and limits.
DEFAULT_HEADER = "// ===== FILE: {path} ====="
DEFAULT_FOOTER = "// ===== END: {path} ====="
DEFAULT_SEPARATOR = "\n\n"
DEFAULT_FILE_NAME = "project-{timestamp}.txt"
DEFAULT_MAX_TOKENS = 100_000
DEFAULT_MAX_FILE_KB = 500


@dataclass(frozen=True)
class FullScan:
    name: str
    root: str = "./"
    respect_gitignore: bool = True
    extensions: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    type: str = "full"


@dataclass(frozen=True)
class PatternScan:
    name: str
    patterns: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    type: str = "pattern"


@dataclass(frozen=True)
class FolderScan:
    name: str
    paths: tuple[str, ...] = ()
    recursive: bool = True
    max_depth: int | None = None
    extensions: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    type: str = "folder"


@dataclass(frozen=True)
class DependencyScan:
    name: str
    entry: str = ""
    symbols: tuple[str, ...] = ()
    depth: int = 2
    include_types: bool = True
    include_node_modules: bool = False
    exclude: tuple[str, ...] = ()
    type: str = "dependency"


# Kinds of strategies; select.register_strategy adds to them.
KINDS = {"full", "pattern", "folder", "dependency"}
Scan = FullScan | PatternScan | FolderScan | DependencyScan


@dataclass(frozen=True)
class Format:
    header: str = DEFAULT_HEADER
    footer: str = DEFAULT_FOOTER
    separator: str = DEFAULT_SEPARATOR
    collapse_blank_lines: bool = True
    strip_comments: bool = False
    strip_imports: bool = False
    keep_license_header: bool = True
    line_numbers: bool = False
    max_file_kb: float = DEFAULT_MAX_FILE_KB
    encoding: str = "utf8"

    def __post_init__(self):
        # An empty template means "use the default".
        for name, default in (
            ("header", DEFAULT_HEADER),
            ("footer", DEFAULT_FOOTER),
            ("separator", DEFAULT_SEPARATOR),
        ):
            if not getattr(self, name):
                object.__setattr__(self, name, default)


@dataclass(frozen=True)
class Filters:
    exclude: tuple[str, ...] = DEFAULT_EXCLUDE
    respect_gitignore: bool = True
    binary_detection: bool = True


@dataclass(frozen=True)
class Budget:
    enabled: bool = True
    max_tokens: int = DEFAULT_MAX_TOKENS
    split: bool = True


@dataclass(frozen=True)
class Output:
    mode: str = "single"
    file_name: str = DEFAULT_FILE_NAME
    group_by: str | Column = "reason"
    manifest: bool = True
    tree: bool = True


@dataclass(frozen=True)
class ExportSpec:
    strategies: tuple[Scan, ...] = (FullScan("everything"),)
    output: Output = field(default_factory=Output)
    format: Format = field(default_factory=Format)
    filters: Filters = field(default_factory=Filters)
    budget: Budget = field(default_factory=Budget)
    export_ts: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def __post_init__(self):
        problems = check(self)
        if problems:
            raise ValueError("; ".join(f"{where}: {what}" for where, what in problems))

    @property
    def iso_ts(self) -> str:
        ts = self.export_ts
        if ts.tzinfo is not None:
            ts = ts.astimezone(timezone.utc)
        return ts.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ts.microsecond // 1000:03d}Z"

    def selected(self, names=None) -> list[tuple[int, Scan]]:
        """Strategies to run, in config order; no names means all, unknown names are ignored."""
        return [(i, s) for i, s in enumerate(self.strategies) if not names or s.name in names]


def check(spec: ExportSpec) -> list[tuple[str, str]]:
    """(place, message) of every bad setting."""
    found = []
    if spec.output.mode not in ("single", "multi"):
        found.append(("output.mode", f"unknown mode {spec.output.mode!r}; choose single or multi"))
    by = spec.output.group_by
    if not isinstance(by, Column) and by not in ("reason", "strategy", "folder", "custom"):
        found.append(("output.group_by", "takes reason, strategy, folder, custom or a Column"))
    needs = {"pattern": ("patterns", "a list of globs"), "folder": ("paths", "a list of folders or files"),
             "dependency": ("entry", "the path of a file")}
    for i, scan in enumerate(spec.strategies):
        if not isinstance(scan.name, str) or not scan.name:
            found.append((f"strategies[{i}].name", "every strategy is called by a name, which is text"))
        if scan.type not in KINDS:
            found.append((f"strategies[{i}].type", f"no strategy of kind {scan.type!r}; known are {', '.join(sorted(KINDS))}"))
        if scan.type in needs:
            attribute, what = needs[scan.type]
            value = getattr(scan, attribute)
            if not value or (attribute != "entry" and isinstance(value, str)):
                found.append((f"strategies[{i}].{attribute}", f"needs {what}"))
    return found

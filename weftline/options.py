"""Options of a job, validated where they are made."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

STRATEGIES = ("SymbolBoundary", "SizeLimited", "LineLimited", "Semantic")
#: Config files in the order in which they are looked for; other names are a parameter of Config.load.
CONFIG_FILES = ("weftline.json", ".weftline.json", "config.json")


@dataclass(frozen=True)
class ChunkingOptions:
    strategy: str = "Semantic"
    max_lines: int = 200
    overlap_lines: int = 1
    include_context: bool = True
    token_counting: bool = False
    #: A tokenizer file by which token_counting counts; without one counts are null.
    tokenizer: str | None = None
    #: Names of strategies besides the four.
    own_strategies: tuple[str, ...] = ()

    def __post_init__(self):
        if self.strategy not in (*STRATEGIES, *self.own_strategies):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.max_lines < 0 or self.overlap_lines < 0:
            raise ValueError("limits are not negative")


@dataclass(frozen=True)
class FlowOptions:
    """Flow control: pause at max_queue_size open events, resume below threshold_percent of it."""

    max_queue_size: int = 500
    threshold_percent: int = 90
    ack_required: bool = False
    pause_timeout_secs: int = 300

    def __post_init__(self):
        if self.max_queue_size < 10:
            raise ValueError("max_queue_size must be at least 10")
        if not 80 <= self.threshold_percent <= 99:
            raise ValueError("threshold_percent must be from 80 to 99")

    @property
    def resume_threshold(self) -> int:
        return self.max_queue_size * self.threshold_percent // 100

    def should_pause(self, size: int) -> bool:
        return size >= self.max_queue_size

    def should_resume(self, size: int) -> bool:
        return size < self.resume_threshold

    def reason(self, size: int) -> str:
        return "output_queue_full" if size >= self.max_queue_size else "output_queue_near_capacity"


@dataclass(frozen=True)
class ScanOptions:
    include: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    follow_symlinks: bool = False
    #: Whether the folder's ignore files count.
    load_ignores: bool = True


@dataclass(frozen=True)
class IndexOptions:
    scan: ScanOptions = field(default_factory=ScanOptions)
    chunking: ChunkingOptions = field(default_factory=ChunkingOptions)
    flow: FlowOptions | None = None
    extract_imports: bool = True
    extract_calls: bool = True
    digest: str = "blake3"
    line_base: str = "auto"


@dataclass(frozen=True)
class Config:
    max_concurrency: int
    max_queue_size: int = 100

    @classmethod
    def load(cls, folder: str = ".", env: dict[str, str] | None = None, names: tuple[str, ...] = CONFIG_FILES) -> Config:
        """The first config file there is, else the environment, else the number of processors and 100."""
        env = os.environ if env is None else env
        number = lambda v, d: int(v) if str(v).isdigit() else d
        cpus = os.cpu_count() or 1
        for name in names:
            if (p := Path(folder, name)).is_file():
                got = json.loads(p.read_text())
                return cls(number(got.get("max_concurrency"), cpus), number(got.get("max_queue_size"), 100))
        return cls(number(env.get("MAX_CONCURRENCY"), cpus), number(env.get("MAX_QUEUE_SIZE"), 100))

"""Property lists: the settings of files, datasets and links.

Each is an immutable record with defaults; `build(cls, **changes)` checks names and values. Which of them have an effect here: userblock (file create), filters,
chunk, fill_value, virtual_map (dataset create), create_intermediate_group (link create; always on). The others are kept and given back, as Spark plans I/O itself.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

from .errors import GridError


@dataclass(frozen=True)
class PropertyList:
    def properties(self) -> list[str]:
        return sorted(f.name for f in fields(self))

    def has(self, name: str) -> bool:
        return name in self.properties()

    def __len__(self) -> int:
        return len(fields(self))

    @property
    def is_empty(self) -> bool:
        return len(self) == 0

    def with_(self, **changes: Any) -> PropertyList:
        unknown = set(changes) - set(self.properties())
        if unknown:
            raise GridError(f"{type(self).__name__} has no {sorted(unknown)}")
        return replace(self, **changes)

    @classmethod
    def class_name(cls) -> str:
        return next(k for k, v in CLASSES.items() if v is cls)

    def is_class(self, name: str) -> bool:
        return self.class_name() == name


@dataclass(frozen=True)
class FileCreate(PropertyList):
    userblock: int = 0
    sym_k: tuple[int, int] = (16, 4)
    istore_k: int = 32
    shared_mesg_phase_change: tuple[int, int] = (50, 40)
    shared_mesg_indexes: tuple[tuple[frozenset[str], int], ...] = ()
    obj_track_times: bool = True
    attr_phase_change: tuple[int, int] = (8, 6)
    attr_creation_order: frozenset[str] = frozenset()
    file_space_page_size: int = 4096
    file_space_strategy: str = "fsm_aggregated"

    def __post_init__(self):
        if self.userblock and (self.userblock < 512 or self.userblock & (self.userblock - 1)):
            raise GridError("a userblock is a power of two of at least 512 bytes")
        if self.file_space_strategy not in ("fsm_aggregated", "paged", "aggregated", "none"):
            raise GridError(f"file space strategy {self.file_space_strategy!r}")


@dataclass(frozen=True)
class FileAccess(PropertyList):
    driver: str = "sec2"
    evict_on_close: bool = False
    write_tracking: int = 0
    metadata_read_attempts: int = 1
    mdc_config: tuple = ()
    mdc_image_config: bool = False
    mdc_log_options: str | None = None
    page_buffer_size: tuple[int, int, int] = (0, 0, 0)
    elink_file_cache_size: int = 0
    all_coll_metadata_ops: bool = False
    coll_metadata_write: bool = False
    fclose_degree: str = "default"
    alignment: tuple[int, int] = (1, 1)
    chunk_cache: tuple[int, int, float] = (521, 1 << 20, 0.75)
    meta_block_size: int = 2048
    sieve_buf_size: int = 65536
    gc_references: bool = False
    small_data_block_size: int = 2048
    libver_bounds: tuple[str, str] = ("earliest", "latest")

    def __post_init__(self):
        if self.driver not in ("sec2", "stdio", "core", "family", "split", "log", "multi", "direct", "mpio"):
            raise GridError(f"driver {self.driver!r}")
        if self.fclose_degree not in ("default", "weak", "semi", "strong"):
            raise GridError(f"close degree {self.fclose_degree!r}")


@dataclass(frozen=True)
class DatasetCreate(PropertyList):
    filters: tuple = ()
    alloc_time: str | None = None
    fill_time: str = "if_set"
    fill_value: Any = None
    chunk: tuple[int, ...] | None = None
    layout: str | None = None
    chunk_opts: frozenset[str] = frozenset()
    external: tuple = ()
    virtual_map: tuple = ()
    obj_track_times: bool = True
    attr_phase_change: tuple[int, int] = (8, 6)
    attr_creation_order: frozenset[str] = frozenset()

    def __post_init__(self):
        if self.layout not in (None, "compact", "contiguous", "chunked", "virtual"):
            raise GridError(f"layout {self.layout!r}")
        if self.external:
            raise GridError("external storage is not written")
        if self.chunk is not None and (not self.chunk or min(self.chunk) < 1):
            raise GridError(f"chunk {self.chunk}")

    def arguments(self) -> dict[str, Any]:
        """As keywords of ContainerWriter.dataset."""
        return {"filters": self.filters, "fill": self.fill_value, "chunk": self.chunk, "compact": self.layout == "compact"}


@dataclass(frozen=True)
class DatasetAccess(PropertyList):
    chunk_cache: tuple[int, int, float] = (521, 1 << 20, 0.75)
    efile_prefix: str = ""
    virtual_view: str = "last_available"
    virtual_printf_gap: int = 0


@dataclass(frozen=True)
class LinkCreate(PropertyList):
    create_intermediate_group: bool = True
    char_encoding: str = "utf8"

    def __post_init__(self):
        if self.char_encoding not in ("ascii", "utf8"):
            raise GridError(f"encoding {self.char_encoding!r}")


# Names of the classes; those without a type have no properties here.
CLASSES: dict[str, type | None] = {
    "attribute access": None,
    "attribute create": None,
    "dataset access": DatasetAccess,
    "dataset create": DatasetCreate,
    "data transfer": None,
    "file access": FileAccess,
    "file create": FileCreate,
    "file mount": None,
    "group access": None,
    "group create": None,
    "link access": None,
    "link create": LinkCreate,
    "object copy": None,
    "object create": None,
    "datatype create": None,
    "string create": None,
}


def build(kind: str | type, **changes: Any) -> PropertyList:
    cls = CLASSES.get(kind) if isinstance(kind, str) else kind
    if cls is None:
        raise GridError(f"no property list class {kind!r}")
    return cls().with_(**changes)

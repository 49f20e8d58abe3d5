"""Table metadata, key rules and errors."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from enum import Enum
from typing import Any

MAX_DOCUMENT = 400 * 1024
MAX_PARTITION_KEY = 2048
MAX_SORT_KEY = 1024
MAX_DEPTH = 16
MAX_BATCH_GET = 1000


class KeyType(str, Enum):
    STRING = "String"
    NUMBER = "Number"
    BINARY = "Binary"

    @classmethod
    def parse(cls, text: str) -> KeyType:
        found = {"string": cls.STRING, "s": cls.STRING, "number": cls.NUMBER, "n": cls.NUMBER, "binary": cls.BINARY, "b": cls.BINARY}.get(text.lower())
        if found is None:
            raise InvalidKeyType(f"unknown key type: {text}")
        return found


class AttrType(str, Enum):
    STRING = "String"
    NUMBER = "Number"
    BOOLEAN = "Boolean"

    @classmethod
    def parse(cls, text: str) -> AttrType:
        found = {"string": cls.STRING, "s": cls.STRING, "number": cls.NUMBER, "n": cls.NUMBER, "boolean": cls.BOOLEAN, "bool": cls.BOOLEAN, "b": cls.BOOLEAN}.get(text.lower())
        if found is None:
            raise InvalidAttrType(f"unknown attribute type: {text}")
        return found


class DocError(Exception):
    """Base of all errors; its class name is the error's name on the wire where the wire has one."""


def _error(name: str, doc: str = "") -> type[DocError]:
    return type(name, (DocError,), {"__doc__": doc or name, "__module__": __name__})


NaN = _error("NaN", "NaN is no key.")
DocumentTooLarge = _error("DocumentTooLarge")
NullByteInKey = _error("NullByteInKey")
KeyTooLarge = _error("KeyTooLarge")
ConditionCheckFailed = _error("ConditionCheckFailed")
TableNotFound = _error("TableNotFound")
TableAlreadyExists = _error("TableAlreadyExists")
KeyTypeMismatch = _error("KeyTypeMismatch")
MissingKeyAttribute = _error("MissingKeyAttribute")
PartitionSchemaNotFound = _error("PartitionSchemaNotFound")
PartitionSchemaAlreadyExists = _error("PartitionSchemaAlreadyExists")
PartitionSchemaHasIndexes = _error("PartitionSchemaHasIndexes")
PartitionSchemaRequiresStringKey = _error("PartitionSchemaRequiresStringKey")
IndexNotFound = _error("IndexNotFound")
IndexAlreadyExists = _error("IndexAlreadyExists")
KeyAttributeUpdate = _error("KeyAttributeUpdate")
UpdateTypeMismatch = _error("UpdateTypeMismatch")
InvalidUpdateAction = _error("InvalidUpdateAction")
InvalidExpression = _error("InvalidExpression")
InvalidCondition = _error("InvalidCondition")
PartitionKeyRequired = _error("PartitionKeyRequired")
SortKeyRequired = _error("SortKeyRequired", "A table with a sort key was addressed without one.")
SortKeyNotSupported = _error("SortKeyNotSupported")
IndexKeyRequired = _error("IndexKeyRequired")
InvalidIndexCursor = _error("InvalidIndexCursor")
InvalidKeyType = _error("InvalidKeyType")
InvalidAttrType = _error("InvalidAttrType")
BatchSizeLimitExceeded = _error("BatchSizeLimitExceeded")
DatabaseLocked = _error("DatabaseLocked", "Another writer committed the same transaction number.")
SnapshotUnavailable = _error("SnapshotUnavailable", "Compaction has merged the versions before that snapshot.")


class VersionMismatch(DocError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"version mismatch: expected {expected}, actual {actual}")
        self.expected, self.actual = expected, actual


class ValidationFailed(DocError):
    def __init__(self, prefix: str, errors: list[str]):
        super().__init__(f"validation failed for prefix '{prefix}': {'; '.join(errors)}")
        self.prefix, self.errors = prefix, errors


@dataclass(frozen=True)
class TableSchema:
    name: str
    partition_key: str
    partition_type: KeyType = KeyType.STRING
    sort_key: str | None = None
    sort_type: KeyType | None = None
    ttl_attribute: str | None = None

    @property
    def keys(self) -> list[str]:
        return [self.partition_key] + ([self.sort_key] if self.sort_key else [])

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, d: dict) -> TableSchema:
        return cls(d["name"], d["partition_key"], KeyType(d["partition_type"]), d.get("sort_key"), KeyType(d["sort_type"]) if d.get("sort_type") else None, d.get("ttl_attribute"))


@dataclass(frozen=True)
class AttributeDef:
    name: str
    type: AttrType
    required: bool = False


@dataclass(frozen=True)
class PartitionSchema:
    prefix: str
    description: str = ""
    attributes: tuple[AttributeDef, ...] = ()
    validate: bool = False

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, d: dict) -> PartitionSchema:
        return cls(d["prefix"], d.get("description", ""), tuple(AttributeDef(a["name"], AttrType(a["type"]), a["required"]) for a in d.get("attributes", [])), d.get("validate", False))


@dataclass(frozen=True)
class IndexDefinition:
    name: str
    attribute: str
    key_type: KeyType
    partition_schema: str | None = None

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, d: dict) -> IndexDefinition:
        return cls(d["name"], d["attribute"], KeyType(d["key_type"]), d.get("partition_schema"))


@dataclass
class Page:
    """Items of one read, and where the next one starts; no cursor when nothing is left."""

    items: list[dict]
    last_evaluated_key: dict | None = None
    extra: dict = field(default_factory=dict)


def check_key(value: Any, kind: KeyType, name: str, most: int = MAX_PARTITION_KEY) -> Any:
    """The key value in its stored form: str, float or bytes. Raises on the wrong type, NaN, NUL and excess size."""
    if kind is KeyType.STRING:
        if not isinstance(value, str):
            raise KeyTypeMismatch(f"key type mismatch for attribute '{name}': expected String, got {type(value).__name__}")
        if "\0" in value:
            raise NullByteInKey("null byte is not allowed in string keys")
        if len(value.encode()) > most:
            raise KeyTooLarge(f"key exceeds maximum size of {most} bytes (got {len(value.encode())})")
        return value
    if kind is KeyType.NUMBER:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise KeyTypeMismatch(f"key type mismatch for attribute '{name}': expected Number, got {type(value).__name__}")
        if math.isnan(value):
            raise NaN("NaN is not a valid key value")
        return float(value) + 0.0
    if isinstance(value, (bytes, bytearray)):
        value = list(value)
    if not isinstance(value, list) or not all(isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= 255 for x in value):
        raise KeyTypeMismatch(f"key type mismatch for attribute '{name}': expected Binary, a list of bytes")
    if len(value) > most:
        raise KeyTooLarge(f"key exceeds maximum size of {most} bytes (got {len(value)})")
    return bytes(value)


def key_to_json(value: Any) -> Any:
    """A stored key as JSON: numbers as floats, bytes as a list."""
    return list(value) if isinstance(value, (bytes, bytearray)) else value


def prefix_of(key: Any) -> str | None:
    """Text before the first '#', else the whole key; only string keys have one."""
    return key.split("#", 1)[0] if isinstance(key, str) else None

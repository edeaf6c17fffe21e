"""Structure of single documents, with the format and encoding found or asserted."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from bomstrata.frontend.run import UnreadableError
from bomstrata.sources.detect import detect
from bomstrata.sources.documents import Reader
from bomstrata.operators.licenses import LicenseTables


@dataclass
class SchemaResult:
    valid: bool
    format: str
    version: str
    encoding: str
    errors: list[str] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return f"{self.format}-{self.encoding}"

    def __str__(self) -> str:
        head = f"{self.format} {self.version} ({self.encoding}): {'valid' if self.valid else 'INVALID'}"
        return "\n".join([head, *(f"  - {e}" for e in self.errors)])

    def as_dict(self) -> dict:
        return asdict(self)


class SchemaChecker:
    """Checks one document at a time; ``engine`` checks corpora."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def validate(self, path: str) -> SchemaResult:
        with open(path, encoding="utf-8", errors="replace") as f:
            whole = f.read()
        df = self.spark.createDataFrame([(whole,)], "t string")
        k = df.select(detect(df["t"]).alias("k")).first()["k"]
        if k["error"]:
            raise UnreadableError(f"{path}: {k['error']}")
        row = Reader(LicenseTables()).row(0, whole, k["sbom_format"], k["spec_version"], k["encoding"])
        return SchemaResult(not row["schema_errors"], k["sbom_format"], k["spec_version"], k["encoding"], list(row["schema_errors"]))

    def expect(self, path: str, kind: str) -> str:
        """``Valid``, what is wrong, or how the document's kind (``spdx-json``) differs from the asserted one."""
        r = self.validate(path)
        if r.kind != kind:
            return f"Format mismatch: detected {r.format} ({r.encoding}), expected {' ('.join(kind.split('-'))})"
        return "Valid" if r.valid else "; ".join(r.errors) or "Invalid"

    def validate_spdx_json(self, path: str) -> str:
        return self.expect(path, "spdx-json")

    def validate_spdx_xml(self, path: str) -> str:
        return self.expect(path, "spdx-xml")

    def validate_cyclonedx_json(self, path: str) -> str:
        return self.expect(path, "cyclonedx-json")

    def validate_cyclonedx_xml(self, path: str) -> str:
        return self.expect(path, "cyclonedx-xml")

"""A dataset: a DataFrame of scored records with roles, a boolean target and an explicit row id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.functions.search_features import nan_features
from peptrail.operators.qvalues import coerce_target
from peptrail.roles import ColumnRoles, infer_roles

ROW_ID = "_row_id"
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


@dataclass(frozen=True)
class PsmDataset:
    df: DataFrame
    roles: ColumnRoles
    name: str = ""

    @classmethod
    def of(cls, df: DataFrame, roles: ColumnRoles | None = None, name: str = "", row_id: str | None = None, drop_na_features: bool = True, **named: str | None) -> PsmDataset:
        """Checks and prepares df: target to boolean, features with nulls dropped (unless kept), a row id.

        Without ``row_id`` the id is a hash of the whole row: it doesn't depend on partitions, and equal rows share it.
        ValueError without rows, targets or decoys.
        """
        if roles is None:
            numeric = [f.name for f in df.schema.fields if f.dataType.simpleString() in _NUMERIC]
            roles = infer_roles([c for c in df.columns if c != row_id], numeric, **named)
        if df.isEmpty():
            raise ValueError("the dataset has no rows")
        out = coerce_target(df, roles.target)
        ident = F.col(row_id) if row_id else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        out = out.withColumn(ROW_ID, ident)
        if drop_na_features and (wrong := nan_features(out, list(roles.features))):
            roles = roles.without_features(wrong)
        return cls(out, roles, name)

    @property
    def targets(self) -> DataFrame:
        return self.df.where(F.col(self.roles.target))

    @property
    def decoys(self) -> DataFrame:
        return self.df.where(~F.col(self.roles.target))

"""Which column plays which role, inferred from names as PIN files have them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Names of further confidence levels, in order, in lower case.
LEVELS = ("modifiedpeptide", "precursor", "peptidegroup")


@dataclass(frozen=True)
class ColumnRoles:
    """Roles of a dataset's columns. The spectrum is the key within which targets and decoys compete."""

    columns: tuple[str, ...]
    target: str
    peptide: str
    spectrum: tuple[str, ...]
    features: tuple[str, ...]
    id: str | None = None
    protein: str | None = None
    levels: tuple[str, ...] = ()
    filename: str | None = None
    scan: str | None = None
    expmass: str | None = None
    calcmass: str | None = None
    rt: str | None = None
    charge: str | None = None
    reserved: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        named = [self.target, self.peptide, *self.spectrum, *self.features, *self.levels]
        named += [c for c in (self.id, self.protein, self.filename, self.scan, self.expmass, self.calcmass, self.rt, self.charge) if c]
        if missing := [c for c in named if c not in self.columns]:
            raise ValueError(f"no such column: {', '.join(missing)}")
        if self.target in self.features:
            raise ValueError("the target column must not be a feature")
        if len(set(self.features)) != len(self.features):
            raise ValueError("a feature occurs twice")

    def without_features(self, drop: list[str]) -> ColumnRoles:
        return replace(self, features=tuple(f for f in self.features if f not in drop))


def find_column(columns: list[str], name: str, required: bool = True, exact: bool = False) -> str | None:
    """The one column of that name, in any case unless ``exact``; ValueError if it is missing though required, or ambiguous."""
    found = [c for c in columns if (c == name if exact else c.lower() == name.lower())]
    if len(found) > 1:
        raise ValueError(f"column {name} is ambiguous: {', '.join(found)}")
    if not found and required:
        raise ValueError(f"column {name} is missing")
    return found[0] if found else None


def infer_roles(columns: list[str], numeric: list[str] | None = None, **named: str | None) -> ColumnRoles:
    """Roles of the columns; a keyword (filename, calcmass, expmass, rt, charge, id, peptide, protein, target, scan) names one explicitly.

    ``numeric``: columns of a type that a feature can have; others left over are no features.
    """
    unknown = set(named) - {"filename", "calcmass", "expmass", "rt", "charge", "id", "peptide", "protein", "target", "scan"}
    if unknown:
        raise ValueError(f"no such role: {', '.join(sorted(unknown))}")

    def role(key: str, name: str, required: bool) -> str | None:
        given = named.get(key)
        return find_column(columns, given, True, True) if given else find_column(columns, name, required)

    ident = named.get("id") or (columns[0] if columns and "id" in columns[0].lower() else find_column(columns, "specid"))
    target, scan = role("target", "label", True), role("scan", "scannr", True)
    peptide, protein = role("peptide", "peptide", True), role("protein", "proteins", True)
    levels = tuple(c for name in LEVELS if (c := find_column(columns, name, False)))
    filename, rt = role("filename", "filename", False), role("rt", "ret_time", False)
    calcmass, expmass = role("calcmass", "calcmass", False), role("expmass", "expmass", False)
    charge = role("charge", "charge_column", False)
    spectrum = tuple(c for c in (filename, scan, rt, expmass) if c)
    taken = {ident, target, scan, peptide, protein, filename, rt, calcmass, expmass, *levels}
    if charge and sum(c.lower().startswith("charge") for c in columns) > 1:
        taken.add(charge)
    features = tuple(c for c in columns if c not in taken and (numeric is None or c in numeric))
    return ColumnRoles(tuple(columns), target, peptide, spectrum, features, ident, protein, levels, filename, scan, expmass, calcmass, rt, charge)

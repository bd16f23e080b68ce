"""Headers of alignment and variant files, parsed and edited on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from strandline.sources.reserved import definition

_TAG = re.compile(r"([A-Za-z][A-Za-z0-9]):(.*)", re.S)
#: Fixed value: the fields that each record kind of an alignment header must have.
_REQUIRED = {"HD": ["VN"], "SQ": ["SN", "LN"], "RG": ["ID"], "PG": ["ID"]}


@dataclass
class SamHeader:
    """``@HD`` fields, and ordered maps of ``@SQ``, ``@RG`` and ``@PG`` records by name or id; comments."""

    hd: dict[str, str] | None = None
    sequences: dict[str, dict[str, str]] = field(default_factory=dict)
    groups: dict[str, dict[str, str]] = field(default_factory=dict)
    programs: dict[str, dict[str, str]] = field(default_factory=dict)
    comments: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> SamHeader:
        h = cls()
        for i, line in enumerate(x.rstrip("\r") for x in text.split("\n") if x.strip()):
            if not line.startswith("@") or len(line) < 3:
                raise ValueError(f"invalid header line: {line!r}")
            kind, rest = line[1:3], line[4:]
            if kind == "CO":
                h.comments.append(rest)
                continue
            fields: dict[str, str] = {}
            for item in rest.split("\t"):
                m = _TAG.fullmatch(item)
                if not m:
                    raise ValueError(f"invalid header field: {item!r}")
                if m[1] in fields:
                    raise ValueError(f"repeated header field: {m[1]}")
                fields[m[1]] = m[2]
            if kind not in _REQUIRED:
                raise ValueError(f"invalid header record: @{kind}")
            missing = [t for t in _REQUIRED[kind] if t not in fields]
            if missing:
                raise ValueError(f"@{kind} lacks {missing[0]}")
            h._add(kind, fields, first=i == 0)
        return h

    def _add(self, kind: str, fields: dict[str, str], *, first: bool) -> None:
        if kind == "HD":
            if not first:
                raise ValueError("@HD must be the first record")
            if not re.fullmatch(r"[0-9]+\.[0-9]+", fields["VN"]):
                raise ValueError("invalid version")
            self.hd = fields
            return
        into, key = {"SQ": (self.sequences, "SN"), "RG": (self.groups, "ID"), "PG": (self.programs, "ID")}[kind]
        if kind == "SQ" and not (fields["LN"].isdigit() and 1 <= int(fields["LN"]) < 2**31):
            raise ValueError("invalid sequence length")
        if fields[key] in into:
            raise ValueError(f"repeated {key} {fields[key]!r}")
        into[fields[key]] = fields

    def __str__(self) -> str:
        row = lambda kind, f: "\t".join([f"@{kind}", *[f"{k}:{v}" for k, v in f.items()]])
        lines = [row("HD", self.hd)] if self.hd else []
        for kind, records in (("SQ", self.sequences), ("RG", self.groups), ("PG", self.programs)):
            lines += [row(kind, f) for f in records.values()]
        lines += [f"@CO\t{c}" for c in self.comments]
        return "".join(f"{x}\n" for x in lines)

    @property
    def is_coordinate_sorted(self) -> bool:
        return bool(self.hd) and self.hd.get("SO") == "coordinate"

    def roots(self) -> list[str]:
        return [p for p, f in self.programs.items() if "PP" not in f]

    def leaves(self) -> list[str]:
        """Programs that no other follows; a cycle of ``PP`` pointers raises."""
        for p in self.programs:
            seen = {p}
            while (nxt := self.programs.get(p, {}).get("PP")) is not None:
                if nxt in seen:
                    raise ValueError("the program chain has a cycle")
                seen.add(nxt)
                p = nxt
        followed = {f["PP"] for f in self.programs.values() if "PP" in f}
        return [p for p in self.programs if p not in followed]

    def add_program(self, name: str, **fields: str) -> None:
        """Append a program to every chain; ids already taken get the id of their parent as a suffix."""
        ends = self.leaves()
        if not ends:
            self.programs[name] = {"ID": name, **fields}
        for end in ends:
            own = name if name not in self.programs else f"{name}-{end}"
            self.programs[own] = {"ID": own, **fields, "PP": end}


#: Names of the eight columns before the samples.
VCF_COLUMNS = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
_STRUCTURED = {"INFO", "FORMAT", "FILTER", "ALT", "contig"}


def _fields(text: str) -> dict[str, str]:
    """``<K=V,K="quoted, text">`` as a dict, escapes resolved."""
    out: dict[str, str] = {}
    for k, q, v in re.findall(r'([^=,<>]+)=(?:"((?:[^"\\]|\\.)*)"|(\[[^\]]*\]|[^,]*))', text[1:-1]):
        if k in out:
            raise ValueError(f"repeated field {k}")
        out[k] = re.sub(r"\\(.)", r"\1", q) if q else v
    return out


@dataclass
class VcfHeader:
    version: tuple[int, int] = (4, 5)
    records: dict[str, dict[str, dict[str, str]]] = field(default_factory=lambda: {k: {} for k in sorted(_STRUCTURED)})
    other: list[tuple[str, str]] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> VcfHeader:
        h = cls()
        lines = [x.rstrip("\r") for x in text.split("\n") if x.strip()]
        if not lines or not (m := re.fullmatch(r"##fileformat=VCFv([0-9]+)\.([0-9]+)", lines[0])):
            raise ValueError("the header must begin with the file format")
        h.version = (int(m[1]), int(m[2]))
        ended = False
        for line in lines[1:]:
            if ended:
                raise ValueError("text after the column names")
            if line.startswith("##"):
                h._record(line[2:])
            elif line.startswith("#CHROM"):
                h._columns(line)
                ended = True
            else:
                raise ValueError(f"invalid header line: {line!r}")
        if not ended:
            raise ValueError("the column names are missing")
        return h

    def _record(self, text: str) -> None:
        key, eq, value = text.partition("=")
        if not eq:
            raise ValueError(f"invalid header record: {text!r}")
        if key == "fileformat":
            raise ValueError("repeated file format")
        if key not in _STRUCTURED:
            self.other.append((key, value))
            return
        if not (value.startswith("<") and value.endswith(">")):
            raise ValueError(f"invalid {key} record")
        f = _fields(value)
        need = {"INFO": ["ID", "Number", "Type", "Description"], "FORMAT": ["ID", "Number", "Type", "Description"]}.get(key, ["ID"])
        for n in need:
            if n not in f:
                raise ValueError(f"{key} lacks {n}")
        if f["ID"] in self.records[key]:
            raise ValueError(f"repeated {key} {f['ID']!r}")
        self.records[key][f["ID"]] = f

    def _columns(self, line: str) -> None:
        names = line.split("\t")
        if names[:8] != VCF_COLUMNS or (len(names) > 8 and names[8] != "FORMAT"):
            raise ValueError("unexpected column names")
        self.samples = names[9:]
        if len(set(self.samples)) != len(self.samples):
            raise ValueError("repeated sample name")

    def __str__(self) -> str:
        quoted = {"Description", "Source", "Version"}
        esc = lambda v: v.replace("\\", "\\\\").replace('"', '\\"')
        row = lambda k, f: f"##{k}=<" + ",".join(f'{n}="{esc(v)}"' if n in quoted else f"{n}={v}" for n, v in f.items()) + ">"
        lines = [f"##fileformat=VCFv{self.version[0]}.{self.version[1]}"]
        lines += [row(k, f) for k in ("INFO", "FILTER", "FORMAT", "ALT", "contig") for f in self.records[k].values()]
        lines += [f"##{k}={v}" for k, v in self.other]
        lines.append("\t".join([*VCF_COLUMNS, *(["FORMAT", *self.samples] if self.samples else [])]))
        return "".join(f"{x}\n" for x in lines)

    def insert(self, kind: str, fields: dict[str, str] | str) -> None:
        """Add a record (fields of ``INFO``, ``FORMAT``, ``FILTER``, ``ALT`` or ``contig``, or the text of another kind); a repeated id raises."""
        if isinstance(fields, str):
            self._record(f"{kind}={fields}")
            return
        quoted = ",".join(f'{k}="{v}"' if k in ("Description", "Source", "Version") else f"{k}={v}" for k, v in fields.items())
        self._record(f"{kind}=<{quoted}>")

    def type_of(self, kind: str, key: str) -> tuple[str, str]:
        """Number and type of an INFO or FORMAT key: as declared, else as reserved in this version, else one String."""
        f = self.records[kind].get(key)
        return (f["Number"], f["Type"]) if f else definition(kind, self.version, key) or ("1", "String")

    def string_map(self) -> dict[str, int]:
        """Numbers of FILTER, INFO and FORMAT ids in the binary format: ``PASS`` is 0, an ``IDX`` field is honoured."""
        out = {"PASS": 0}
        for kind in ("FILTER", "INFO", "FORMAT"):
            for k, f in self.records[kind].items():
                given = int(f["IDX"]) if "IDX" in f else None
                if k in out:
                    if given is not None and given != out[k]:
                        raise ValueError(f"{k} has two numbers")
                    continue
                out[k] = given if given is not None else max(out.values()) + 1
        return out

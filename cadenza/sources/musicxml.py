"""MusicXML scores (plain or zipped) as one row per element, in document order; and back again.

Sibling order is the meaning of a bar, so files are parsed as trees and not by a row tag; every element keeps its place."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}
_FIELDS = (
    "score_id string, part_id string, measure_idx int, measure_no string, implicit boolean, elem_idx int, tag string, staff string, voice string, duration int, "
    "is_chord boolean, is_grace boolean, is_rest boolean, step string, alter double, octave int, tie_start boolean, tie_stop boolean, note_type string, dots int, "
    "divisions int, beats int, beat_type int, fifths int, clef_staff string, clef_sign string, clef_line int, flags array<string>, slur_start array<string>, slur_stop array<string>, "
    "tuplet_start boolean, tuplet_stop boolean, actual_notes int, normal_notes int, beam string, stem string, accidental string, bar_style string"
)
JUMPS = ("segno", "coda", "tocoda", "dalsegno", "dacapo", "fine")
ELEMENTS = T.StructType([T.StructField(f.split()[0], _KINDS[f.split()[1]]) for f in _FIELDS.split(", ")])


def score_bytes(data: bytes) -> bytes:
    """The XML of a file: in a zip the first .xml name outside META-INF."""
    if data[:2] != b"PK":
        return data
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(next(n for n in z.namelist() if n.endswith(".xml") and not n.startswith("META-INF")))


def _number(e: ET.Element | None, name: str, kind=int):
    text = e.findtext(name) if e is not None else None
    try:
        return kind(float(text)) if text not in (None, "") else None
    except ValueError:
        return None


def _flags(e: ET.Element) -> list[str]:
    """The jump names that the sounds of a direction carry, whatever their values."""
    return sorted({k for sound in e.iter("sound") for k in sound.attrib if k in JUMPS}) if e.tag == "direction" else []


def elements(score_id: str, data: bytes) -> Iterator[dict]:
    """The elements of all bars; a file that can't be read has none."""
    try:
        root = ET.fromstring(score_bytes(data))
    except (ET.ParseError, zipfile.BadZipFile, StopIteration):
        return
    if root.tag != "score-partwise":
        return
    empty = dict.fromkeys(ELEMENTS.names)
    for part in root.findall("part"):
        for k, measure in enumerate(part.findall("measure")):
            bar = {"score_id": score_id, "part_id": part.get("id", ""), "measure_idx": k, "measure_no": measure.get("number", ""), "implicit": measure.get("implicit") == "yes"}
            for place, e in enumerate(measure):
                row = empty | bar | {"elem_idx": place, "tag": e.tag, "is_chord": False, "is_grace": False, "is_rest": False, "flags": _flags(e)}
                if e.tag == "note":
                    pitch, slurs = e.find("pitch"), e.findall("notations/slur")
                    ties, tuplets = {t.get("type") for t in e.findall("tie")}, {t.get("type") for t in e.findall("notations/tuplet")}
                    row |= {
                        "staff": e.findtext("staff", "1"), "voice": e.findtext("voice", "1"), "duration": _number(e, "duration"), "is_chord": e.find("chord") is not None,
                        "is_grace": e.find("grace") is not None, "is_rest": e.find("rest") is not None, "step": pitch.findtext("step") if pitch is not None else None,
                        "alter": _number(pitch, "alter", float), "octave": _number(pitch, "octave"), "tie_start": "start" in ties, "tie_stop": "stop" in ties,
                        "note_type": e.findtext("type"), "dots": len(e.findall("dot")), "slur_start": [s.get("number", "1") for s in slurs if s.get("type") == "start"],
                        "slur_stop": [s.get("number", "1") for s in slurs if s.get("type") == "stop"], "tuplet_start": "start" in tuplets, "tuplet_stop": "stop" in tuplets,
                        "actual_notes": _number(e, "time-modification/actual-notes"), "normal_notes": _number(e, "time-modification/normal-notes"),
                        "beam": e.findtext("beam"), "stem": e.findtext("stem"), "accidental": e.findtext("accidental"),
                    }
                elif e.tag in ("backup", "forward"):
                    row |= {"duration": _number(e, "duration"), "staff": e.findtext("staff"), "voice": e.findtext("voice")}
                elif e.tag == "attributes":
                    row |= {"divisions": _number(e, "divisions"), "beats": _number(e, "time/beats"), "beat_type": _number(e, "time/beat-type"), "fifths": _number(e, "key/fifths")}
                    if (clef := e.find("clef")) is not None:
                        row |= {"clef_staff": clef.get("number", "1"), "clef_sign": clef.findtext("sign"), "clef_line": _number(clef, "line")}
                elif e.tag == "barline":
                    row |= {"bar_style": e.findtext("bar-style")}
                yield row


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The elements of all scores under a path. Only whole files are units, so one task reads one or more scores."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(ELEMENTS)

    def parsed(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(elements(name.rsplit("/", 1)[-1], data))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xml,musicxml,mxl}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parsed, ELEMENTS)


def score_xml(rows: list[dict]) -> bytes:
    """A score-partwise document from the elements of one score: notes, backups, forwards and attributes."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<!DOCTYPE score-partwise PUBLIC "-//Recordare//DTD MusicXML 3.1 Partwise//EN" "http://www.musicxml.org/dtds/partwise.dtd">', '<score-partwise version="3.1"><part-list>']
    parts = list(dict.fromkeys(r["part_id"] for r in rows))
    out += [f'<score-part id="{p}"><part-name>{p}</part-name></score-part>' for p in parts] + ["</part-list>"]

    def tag(name: str, value) -> str:
        return "" if value is None else f"<{name}>{value:g}</{name}>" if isinstance(value, float) else f"<{name}>{value}</{name}>"

    for p in parts:
        out.append(f'<part id="{p}">')
        bar = None
        for r in sorted((r for r in rows if r["part_id"] == p), key=lambda r: (r["measure_idx"], r["elem_idx"])):
            if r["measure_idx"] != bar:
                out.append(("</measure>" if bar is not None else "") + f'<measure number="{r["measure_no"]}"' + (' implicit="yes"' if r["implicit"] else "") + ">")
                bar = r["measure_idx"]
            if r["tag"] == "note":
                pitch = f"<pitch>{tag('step', r['step'])}{tag('alter', r['alter'])}{tag('octave', r['octave'])}</pitch>" if r["step"] else "<rest/>"
                ties = "".join(f'<tie type="{k}"/>' for k in ("stop", "start") if r[f"tie_{k}"])
                out.append("<note>" + "<grace/>" * bool(r["is_grace"]) + "<chord/>" * bool(r["is_chord"]) + pitch + tag("duration", None if r["is_grace"] else r["duration"]) + ties + tag("voice", r["voice"]) + tag("type", r["note_type"]) + "<dot/>" * (r["dots"] or 0) + tag("staff", r["staff"]) + "</note>")
            elif r["tag"] in ("backup", "forward"):
                out.append(f"<{r['tag']}>{tag('duration', r['duration'])}</{r['tag']}>")
            elif r["tag"] == "attributes":
                time = f"<time>{tag('beats', r['beats'])}{tag('beat-type', r['beat_type'])}</time>" if r["beats"] else ""
                key = f"<key>{tag('fifths', r['fifths'])}</key>" if r["fifths"] is not None else ""
                clef = f'<clef number="{r["clef_staff"]}">{tag("sign", r["clef_sign"])}{tag("line", r["clef_line"])}</clef>' if r["clef_sign"] else ""
                out.append(f"<attributes>{tag('divisions', r['divisions'])}{key}{time}{clef}</attributes>")
        out.append(("</measure>" if bar is not None else "") + "</part>")
    return "".join([*out, "</score-partwise>"]).encode()


def written_scores(scores: DataFrame) -> DataFrame:
    """score_id and the XML of each score, for a file or table sink."""
    import pandas as pd

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        return pd.DataFrame([(rows[0]["score_id"], score_xml(rows))], columns=["score_id", "content"])

    simple = [f.name for f in ELEMENTS if not isinstance(f.dataType, T.ArrayType)]
    return scores.select(*simple).groupBy("score_id").applyInPandas(write, "score_id string, content binary")

"""Reports with their cases made from the test tables: each row picks its sentences by its numbers, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .adapters import table
from .scratch import spread

#: name: (choices, index in both dialects)
PICKS = {
    "exam": (["CT of the chest", "CT of the head with contrast", "MRI of the lumbar spine", "Ultrasound of the thyroid", "Digital mammography of the breast", "CT of the abdomen", "MRI of the prostate"], "p_partkey % 7"),
    "title": (["COMPUTED TOMOGRAPHY OF THE CHEST", "CT HEAD", "MAGNETIC RESONANCE OF THE LUMBAR SPINE", "ULTRASOUND OF THE THYROID", "MAMMOGRAPHY OF THE BREAST", "COMPUTED TOMOGRAPHY OF THE ABDOMEN", "PROSTATE MRI"], "p_partkey % 7"),
    "first": ([
        "Acute subdural hematoma along the left convexity", "Pulmonary nodule of 6 mm in the right lung", "Thyroid nodule of 1,2 cm in the left lobe", "Breast mass in the right breast", "Simple renal cyst of 3 x 2 cm", "Disc herniation at L4-L5",
        "Small bowel obstruction", "Suspicious area in the prostate", "Pleural effusion on the left", "Rib fracture on the right", "Gallstone without thickening",
    ], "p_partkey % 11"),
    "second": (["no midline shift", "without pneumothorax", "mild steatosis", "no stones but hemorrhage around the pancreas", "stable granuloma", "pulmonary embolism was excluded", "CVC in place", "stroke of the left hemisphere not seen"], "p_size % 8"),
    "said": ([
        "Acute subdural hematoma along the left convexity", "Pulmonary nodule of 6 mm in the left lung", "Nodule of the thyroid of 1,2 cm in the left lobe", "Mass of the right breast", "Simple renal cyst of 3 x 2 cm", "No disc herniation",
        "Bowel obstruction", "Suspicious area in the prostate", "Renal cell carcinoma of the right kidney", "Rib fracture on the right", "Gallstone",
    ], "(p_partkey + p_size) % 11"),
    "value": (["BI-RADS 4A", "BI-RADS: 7", "TI-RADS TR5", "PI-RADS 4", "Lung-RADS 4X", "LR-5 in segment 4", "Bosniak 2F", "BI-RADS", "no category", "Fleischner low-risk"], "(p_partkey + p_size) % 10"),
    "advice": (["Follow-up CT in 3 months", "Biopsy is advised", "Clinical correlation", "MRI for further evaluation within 2 weeks", "Nothing else"], "p_size % 5"),
    "conclusion": (["Acute left subdural hematoma", "Nodule of the lung", "There is a thyroid nodule", "Normal", "Small bowel obstruction, 3 cm", "Otherwise unremarkable"], "(p_partkey + p_size) % 6"),
    "lead": (["Findings", "Analysis", "FINDINGS"], "p_size % 3"),
}
FINDINGS = "concat({first}, '. ', {second}, '.')"
HTML = "concat('<center><b>', {title}, '</b></center><br><br><b>Technique:</b><br>Axial images.<br><br><b>', {lead}, ':</b><br>', {said}, '.<br>', {second}, '; ', {value}, '. The trachea, heart, liver, canal and ventricles are seen in all of the images today.<br><br><b>Impression:</b><br>', {conclusion}, '. ', {advice}, '.')"
REFERENCE = "concat('<b>Technique</b><br>Axial images.<br><b>Findings</b><br>', {first}, '.<br>', {second}, '.<br><b>Impression</b><br>', {first}, '.')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spark(name: str) -> str:
    choices, at = PICKS[name]
    return f"element_at(array({', '.join(map(_quoted, choices))}), cast({at} as int) + 1)"


def _duck(name: str) -> str:
    choices, at = PICKS[name]
    return f"list_extract([{', '.join(map(_quoted, choices))}], CAST({at} AS INTEGER) + 1)"


def _filled(text: str, of) -> str:
    return text.format(**{n: of(n) for n in PICKS})


#: The same rows for an independent engine: case_id, exam, findings, html, reference.
SQL = f"reports AS (SELECT p_partkey AS case_id, {_duck('exam')} AS exam, {_filled(FINDINGS, _duck)} AS findings, {_filled(HTML, _duck)} AS html, {_filled(REFERENCE, _duck)} AS reference FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report is made from; a part is some bytes, its report some milliseconds of work."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, exam, findings, html, reference) for each part."""
    return _parts(spark, sf_dir).selectExpr(
        "cast(p_partkey as bigint) as case_id", f"{_spark('exam')} as exam", f"{_filled(FINDINGS, _spark)} as findings", f"{_filled(HTML, _spark)} as html", f"{_filled(REFERENCE, _spark)} as reference"
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports with gold findings, urgent labels and expectations. A third have gold, a third a reference report, a third neither."""
    first = _spark("first")
    severity = f"case when {first} rlike '(?i)hematoma|obstruction|fracture' then 'critical' when {first} rlike '(?i)nodule|mass|effusion|area' then 'major' else 'minor' end"
    gold = f"""case when p_partkey % 3 = 0 then array(
        named_struct('finding', {first}, 'severity', {severity}, 'location', cast(null as string), 'laterality', case when {first} rlike 'left' then 'left' when {first} rlike 'right' then 'right' end,
            'measurements', regexp_extract_all({first}, '[0-9][0-9,]* (?:mm|cm)', 0), 'negated', false),
        named_struct('finding', {_spark("second")}, 'severity', 'minor', 'location', cast(null as string), 'laterality', cast(null as string), 'measurements', cast(array() as array<string>), 'negated', {_spark("second")} rlike '^(?:no|without) '))
      else cast(array() as array<struct<finding:string,severity:string,location:string,laterality:string,measurements:array<string>,negated:boolean>>) end"""
    expected = "case when p_partkey % 5 = 0 then array(named_struct('guideline', 'birads', 'classification', 'BI-RADS 4A', 'recommendation', 'biopsy or follow-up', 'required', true)) else cast(array() as array<struct<guideline:string,classification:string,recommendation:string,required:boolean>>) end"
    return _parts(spark, sf_dir).selectExpr(
        "cast(p_partkey as bigint) as case_id", f"{_spark('exam')} as exam", f"{_filled(FINDINGS, _spark)} as findings", f"{_filled(HTML, _spark)} as html",
        f"case when p_partkey % 3 = 1 then {_filled(REFERENCE, _spark)} end as reference", f"{gold} as gold", f"case when p_partkey % 6 = 0 then array({first}) else cast(array() as array<string>) end as urgent",
        f"{expected} as expectations", "'en-US' as locale", "case when p_partkey % 4 = 0 then map('a', 2, 'b', 1) end as relevance", "case when p_partkey % 8 = 0 then array('b', 'x', 'a', 'b') else cast(array() as array<string>) end as retrieved",
    )

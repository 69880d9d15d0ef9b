"""Column names and fixed values shared by the operators.

Every operator takes the names as a parameter, so the same code runs on any
table that has the right kinds of columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class PostingColumns:
    """Names of the columns a posting table carries."""

    serial: str = "jobOpening_serialNumber"
    raw_profession: str = "jobOpening_profession"
    profession: str = "jobOpening_professionFinal"
    status: str = "jobOpening_status"
    contract_type: str = "jobOpening_experienceType"
    submitted: str = "jobOpening_submittedAt"
    submitted_at: str = "submitted_at_dt"
    level: str = "jobOpening_workExperienceYears"
    scope: str = "jobOpening_jobScope"
    title: str = "jobOpening_title"
    text: str = "clean_text"
    text_id: str = "text_id"
    raw_skills: str = "raw_skills"
    skill: str = "skills_found"
    total: str = "total_unique_jobs"


DEFAULT_COLUMNS = PostingColumns()


def posting_schema(cols: PostingColumns = DEFAULT_COLUMNS) -> T.StructType:
    """Schema of the raw postings table, every column a nullable string."""
    names = [
        cols.serial,
        cols.raw_profession,
        cols.status,
        cols.contract_type,
        cols.submitted,
        cols.level,
        cols.scope,
        cols.title,
    ]
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# --- Fixed values: results depend on them, so they are stated as they are. ---

LEVELS = ("Junior", "Mid-level", "Senior")

LEVEL_MAP = {
    "NO_EXPERIENCE": "Junior",
    "ONE_TWO_YEARS": "Junior",
    "THREE_FIVE_YEARS": "Mid-level",
    "SIX_TEN_YEARS": "Senior",
    "GREATER_TEN_YEARS": "Senior",
}

KEPT_STATUSES = ("APPROVED", "CLOSED")
KEPT_CONTRACT_TYPES = ("FULL_TIME", "CONTRACT")
PROFESSION_RULES = ((r"SOFTWARE_ENGINEER_.*", "SOFTWARE_ENGINEER"),)

SKILL_ENTITY_GROUPS = ("HSKILL", "SSKILL")
WORDS_PER_CHUNK = 300
SIMILARITY_THRESHOLD = 92
MATRIX_SIZE = 100

SYNONYMS = {
    "bachelor": "bachelor's degree",
    "s degree": "bachelor's degree",
    "bachelor s": "bachelor's degree",
    "bachelor s degree": "bachelor's degree",
    "master": "master's degree",
    "master s": "master's degree",
    "master s degree": "master's degree",
    "apis": "api",
    "c + +": "c++",
    "c +": "c++",
    "react. js": "react",
    "reactjs": "react",
    "node. js": "node.js",
    ". net": ".net",
    "robotic": "robotics",
    "machine vision": "computer vision",
    "verbal communication": "communication",
    "effective communication": "communication",
    "communication skills": "communication",
    "ml": "machine learning",
    "gging": "debugging",
    "native": "react native",
}

STOP_WORDS = (
    "and the", "with", "are", "er", "less", "inform", "aw", "and", "the", "of",
    "to", "in", "for", "on", "at", "by", "from", "as", "with a", "and an",
    "full", "natural", "technical", "motivated", "command", "computing and",
    "solving skills and", "skills", "attention", "organization", "is", "be",
    "an", "red",
)

# --- End of fixed values. ---

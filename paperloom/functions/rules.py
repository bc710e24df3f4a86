"""Vocabularies and constants of the document model (fixed values), and parameter checks that run on the driver."""

from __future__ import annotations

STATUSES = ("Processing", "Ready", "Needs Review", "Failed")
CLASSIFICATIONS = ("Public", "Internal", "Confidential", "Restricted")
ROLES = ("Viewer", "Analyst", "Reviewer", "Administrator")
#: Roles that may see each classification.
ROLES_BY_CLASSIFICATION = {
    "Public": ROLES,
    "Internal": ROLES,
    "Confidential": ("Analyst", "Reviewer", "Administrator"),
    "Restricted": ("Reviewer", "Administrator"),
}
REVIEWERS = ("Administrator", "Reviewer")
DOCUMENT_TYPES = (
    "compliance_report", "financial_report", "regulatory_filing", "policy_document", "contract", "correspondence", "technical_report",
    "meeting_minutes", "research_report", "application_form", "invoice", "other",
)
ENTITY_TYPES = ("organization", "person", "department", "location", "regulator", "contract", "reference", "date", "other")
SEVERITIES = ("low", "medium", "high", "critical")
DATE_TYPES = ("explicit", "relative", "inferred")
QA_CONFIDENCES = ("strong", "weak", "none")
INTELLIGENCE_STAGES = ("document_type", "entities", "risks", "deadlines", "document_summary")
FILE_TYPES = {"PDF": ("pdf",), "DOCX": ("docx",), "XLSX": ("xlsx",), "CSV": ("csv",), "DOC": ("doc",), "JPG": ("jpg", "jpeg"), "PNG": ("png",), "TIFF": ("tiff", "tif")}
ENABLED_TYPES = ("PDF", "DOCX", "XLSX")
MIME_TYPES = {
    "PDF": ("application/pdf",),
    "DOCX": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
    "XLSX": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",),
}
SORTS = {"uploaded_at": "created_at", "name": "name", "size_kb": "size_kb", "year": "year", "status": "status", "pages": "pages"}
#: Characters that count as blank where a text is trimmed.
BLANKS = " \t\n\r\0\x0b"
FLOOR, TEXT_CHARS, CHUNK_CHARS, CHUNKS = 0.3, 60_000, 1_200, 200


def allowed_classifications(role: str) -> list[str]:
    """What a role may see; an unknown role sees nothing."""
    return [c for c, roles in ROLES_BY_CLASSIFICATION.items() if role in roles]


def empty(value) -> bool:
    """Values that count as "no filter": none, empty, and the text ``0``."""
    return value in (None, "", "0", 0, [], ())


def comma_list(value: str | list | None) -> list[str]:
    """Parts of a comma-separated parameter: trimmed, without empty ones and ``0``."""
    parts = value.split(",") if isinstance(value, str) else list(value or ())
    return [p for p in (x.strip(BLANKS) for x in parts) if not empty(p)]


def listing_parameters(params: dict) -> dict:
    """Checked parameters of a listing; a bad value is refused, not changed."""
    out = dict(params)
    for key, allowed in (("status", STATUSES), ("classification", CLASSIFICATIONS)):
        out[key] = comma_list(params.get(key))
        if bad := [x for x in out[key] if x not in allowed]:
            raise ValueError(f"{key}: {bad[0]!r} is not known")
    if params.get("q") is not None and len(params["q"]) > 255:
        raise ValueError("q: at most 255 characters")
    for key, least, most, default in (("year", 2000, 2100, None), ("per_page", 1, 100, 20), ("page", 1, 2**31, 1)):
        value = params.get(key, default)
        if value is not None and not least <= int(value) <= most:
            raise ValueError(f"{key}: must be from {least} to {most}")
        out[key] = None if value is None else int(value)
    out["sort"], out["direction"] = params.get("sort", "uploaded_at"), params.get("direction", "desc")
    if out["sort"] not in SORTS or out["direction"] not in ("asc", "desc"):
        raise ValueError("sort: not known")
    return out


def search_parameters(q: str, limit: int = 10, least: int = 2, most: int = 500, top: int = 50) -> tuple[str, int]:
    """Checked query text and number of hits of a search; questions pass ``least=3, most=1000, top=20``."""
    if not least <= len(q) <= most:
        raise ValueError(f"q: {least} to {most} characters")
    if not 1 <= limit <= top:
        raise ValueError(f"limit: 1 to {top}")
    return q, limit


def clamped_page_size(value, default: int = 20) -> int:
    """Child lists change a page size instead of refusing it, and only at the top."""
    return min(int(default if value is None else value), 100)


def may_upload(workspace_type: str, role: str) -> bool:
    return workspace_type == "Personal" or role in REVIEWERS


def type_for_extension(extension: str | None) -> str | None:
    found = (extension or "").lower().lstrip(".")
    return next((t for t in ENABLED_TYPES if found in FILE_TYPES[t]), None)


def enabled_extensions() -> list[str]:
    return [e for t in ENABLED_TYPES for e in FILE_TYPES[t]]


def enabled_mime_types() -> list[str]:
    return [m for t in ENABLED_TYPES for m in MIME_TYPES[t]]

"""The text a second scoring pass reads: message, first analysis and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.functions.chat import shown


def page_block(page: Column) -> Column:
    """One page of the evidence: title and start of the text, or the failure."""
    good = F.format_string(
        rubric.EVIDENCE_PAGE,
        shown(page["url"]),
        F.coalesce(page["title"], F.lit(rubric.NO_TITLE)),
        F.substring(F.coalesce(page["content"], F.lit("")), 1, rubric.EVIDENCE_CHARS),
    )
    bad = F.format_string(
        rubric.EVIDENCE_FAILED,
        shown(page["url"]),
        F.coalesce(page["error"], F.lit(rubric.UNKNOWN_ERROR)),
    )
    return F.when(page["status"] == "success", good).otherwise(bad)


def evidence_document(text: Column, first_analysis: Column, pages: Column) -> Column:
    head = F.format_string(rubric.EVIDENCE_HEAD, text, first_analysis)
    return F.concat(head, F.array_join(F.transform(pages, page_block), ""))

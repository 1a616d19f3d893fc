"""License text: normal form and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Licenses that allow redistribution.
ALLOWED = ("cc-by", "cc-by-4.0", "cc-by-3.0", "cc-by-2.5", "cc-by-2.0", "cc0", "public-domain", "cc-by-sa", "cc-by-sa-4.0", "cc-by-sa-3.0")
REDISTRIBUTABLE, NEEDS_REVIEW, EXCLUDED = "REDISTRIBUTABLE", "NEEDS_REVIEW", "EXCLUDED"


def normal_license(license_id: Column) -> Column:
    """Lower case without white space around it; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(license_id, F.lit("")), r"^\s+|\s+$", ""))


def license_status(license_id: Column, is_oa: Column | None = None, other_id: Column | None = None) -> Column:
    """An allowed license wins; then closed access excludes; a missing one is looked up in other_id and else needs review; any other excludes."""
    own = normal_license(license_id)
    status = F.when(own.isin(*ALLOWED), REDISTRIBUTABLE)
    if is_oa is not None:
        status = status.when(~is_oa, EXCLUDED)
    if other_id is not None:
        status = status.when((own == "") & normal_license(other_id).isin(*ALLOWED), REDISTRIBUTABLE)
    return status.when(own == "", NEEDS_REVIEW).otherwise(EXCLUDED)

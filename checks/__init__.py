"""Registered queries, each with the SQL that must give the same rows.

Inputs are the driver's tables with deterministic dirt; the dirt expressions are shared by
both sides, everything after them is written twice.
"""

from checks.base import CHECKS

import checks.profiling  # noqa: E402,F401
import checks.scoring  # noqa: E402,F401
import checks.rule_checks  # noqa: E402,F401
import checks.repair  # noqa: E402,F401
import checks.duplicates  # noqa: E402,F401
import checks.tables  # noqa: E402,F401

__all__ = ["CHECKS"]

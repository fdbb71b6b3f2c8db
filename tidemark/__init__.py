"""Tidemark: data-quality and preparation engine on PySpark."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .operators.clean import clean, fill_missing  # noqa: E402
from .operators.profile import compare_quality, profile  # noqa: E402
from .operators.repair import structural_repair  # noqa: E402
from .operators.roles import infer_roles  # noqa: E402
from .operators.standardise import standardise  # noqa: E402
from .plans.cleaning_plan import apply_plan, build_plan, export, fit_plan  # noqa: E402
from .plans.process import process  # noqa: E402
from .plans.ranking import rank_recipes, recommend, select_recipe  # noqa: E402
from .plans.recipes import enhance, fit_recipe, recipe_names, recipe_table  # noqa: E402
from .plans.terrain import characterize  # noqa: E402
from .plans.validation import validate_classification  # noqa: E402
from .sources.csv import read_csv_multiline, read_csv_repaired  # noqa: E402
from .sources.history import commit_scores, load_history, save_history, update_history  # noqa: E402

__all__ = [
    "apply_plan", "build_plan", "characterize", "clean", "compare_quality", "enhance", "export", "fill_missing",
    "fit_plan", "fit_recipe", "infer_roles", "load_history", "process", "profile", "rank_recipes",
    "read_csv_multiline", "read_csv_repaired", "recipe_names", "recipe_table", "recommend", "save_history",
    "select_recipe", "standardise", "structural_repair", "update_history", "validate_classification",
]

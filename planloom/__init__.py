"""Search over data-preparation and modelling pipelines on Spark."""

from planloom.config import config, get_config, set_config
from planloom.operators.categories import OneHotEncoder, TargetEncoder
from planloom.operators.linear import DummyRegressor, ElasticNet, Lasso, LinearRegression, Ridge
from planloom.operators.scaling import StandardScaler
from planloom.operators.text import StringEncoder
from planloom.operators.trees import GradientBoostedRegressor, RandomForestRegressor
from planloom.operators.vectorizer import TableVectorizer
from planloom.plans.cv import Holdout, KFold, Scorer, evaluate, grid_search, value
from planloom.plans.nodes import Op, choose_from, eval_mode, literal, param, scan, table, to_dot
from planloom.plans.rewrite import RewriteConfig, dedupe, optimize
from planloom.plans.runtime import Numeric, RejectColumn

__version__ = "0.1.0"
__all__ = [
    "DummyRegressor", "ElasticNet", "GradientBoostedRegressor", "Holdout", "KFold", "Lasso", "LinearRegression", "Numeric", "OneHotEncoder", "Op", "RandomForestRegressor", "RejectColumn", "RewriteConfig", "Ridge",
    "Scorer", "StandardScaler", "StringEncoder", "TableVectorizer", "TargetEncoder", "choose_from", "config", "dedupe", "eval_mode", "evaluate", "get_config", "grid_search", "literal", "optimize", "param",
    "scan", "set_config", "table", "to_dot", "value",
]

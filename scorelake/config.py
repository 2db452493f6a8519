"""Defaults of the evaluation workflow. All functions take them as arguments as well."""

from __future__ import annotations

# Column names, sizes, model parameters and search grids that results depend on.
FEATURE_COLUMNS = [
    "PA_mean", "PA_std",
    "WW_mean", "WW_std",
    "SW_mean", "SW_std",
    "NW_mean", "NW_std",
    "VWA", "MWA", "W/B",
    "VRC", "MRC",
    "Gender", "Age", "US_born",
    "HH_Income", "HH_size",
    "Edu_level",
]
TARGET_COLUMN = "Health_status"
ID_COLUMN = "SEQN"

RANDOM_STATE = 42
TEST_SIZE = 0.3
SAMPLE_SIZE = 200
HIGH_MISSING_SHARE = 0.1
SIGNIFICANCE_LEVEL = 0.05
MAX_ATTEMPTS = 3
SCORING_BATCH = 10
CALL_SECONDS = 30.0
FRAMES_AT_ONCE = 4

MODEL_PARAMS = {
    "RandomForest": {"numTrees": 100, "maxDepth": 0, "minInstancesPerNode": 1},
    "LogisticRegression": {"C": 1.0, "penalty": "l2", "maxIter": 1000},
    "SVM": {"C": 1.0, "kernel": "rbf", "gamma": "scale"},
    "GradientBoosting": {"positiveWeight": 4.0, "maxIter": 100, "maxDepth": 6, "stepSize": 0.1},
}

# Search grids; depth 0 means no limit.
PARAM_GRIDS = {
    "RandomForest": {
        "numTrees": [50, 100, 200, 300],
        "maxDepth": [0, 10, 20],
        "minInstancesPerNode": [1, 2, 4],
        "featureSubsetStrategy": ["sqrt", "log2", "all"],
    },
    "LogisticRegression": {
        "C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0],
        "penalty": ["l1", "l2"],
        "maxIter": [1000, 2000, 5000],
    },
    "SVM": {
        "C": [0.1, 1.0, 10.0, 100.0],
        "gamma": ["scale", "auto", 0.001, 0.01, 0.1, 1.0],
        "kernel": ["rbf", "linear", "poly"],
    },
    "GradientBoosting": {
        "maxIter": [50, 100, 200],
        "maxDepth": [3, 6, 9],
        "stepSize": [0.01, 0.1, 0.2],
        "subsamplingRate": [0.8, 0.9, 1.0],
        "columnRate": [0.8, 0.9, 1.0],
    },
}

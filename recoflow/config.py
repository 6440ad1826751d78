"""Constants that carry meaning for results (fixed values of the model)."""

# List length, temporal slice fractions, seed.
DEFAULT_K = 72
TRAIN_FRACTION = 0.7
TEST_FRACTION = 0.2
SEED = 42

# Item ids in the raw history carry this prefix ("I123").
ITEM_PREFIX = "I"
# Padding token of the wide ground-truth export.
TRUTH_PAD = "0"

# Hybrid defaults of the reference model (clusters, ALS iterations, regularisation, rank).
HYBRID_DEFAULTS = {"k": 5000, "max_iter": 20, "reg_param": 0.1, "rank": 200}

# ALS blocks. They change the start factors, hence the model: they are kept with a model's settings.
# A block's ratings lie in one task's memory, so above ALS_BLOCK_RATINGS of them for each block there are
# more blocks (als.blocks), never fewer; every block more is one more copy of the factors that it reads.
ALS_USER_BLOCKS = 10
ALS_ITEM_BLOCKS = 2
ALS_BLOCK_SIZE = 4096
ALS_BLOCK_RATINGS = 20_000_000

# ALS grid of the reference's cross-validated search.
ALS_GRID = {"maxIter": [10, 15, 20], "regParam": [0.01, 0.1, 0.3, 1.0], "rank": [5, 15, 25]}
ALS_FOLDS = 10

# Silhouette sweep of the reference: k = 12..101, then 200..1100 in steps of 100.
SILHOUETTE_SWEEP = list(range(12, 102)) + list(range(200, 1200, 100))

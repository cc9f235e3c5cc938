"""Operations of a large-scale training-data pipeline: deduplication, filtering, scanning, tokenising and scoring."""

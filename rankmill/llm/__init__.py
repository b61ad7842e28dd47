"""Operations of a training-data pipeline: filters, deduplication, mixing, sharding, tokenising, rendering."""

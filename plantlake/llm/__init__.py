"""Operations of a training-data pipeline: each takes and returns DataFrames."""

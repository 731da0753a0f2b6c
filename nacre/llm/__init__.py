"""Operations of a large-scale training-data pipeline. Nothing else in this library imports this subpackage."""

"""frameloom: DataFrame operators for measuring annotated, frame-ordered observations."""

"""Record linkage and identity resolution over DataFrames."""

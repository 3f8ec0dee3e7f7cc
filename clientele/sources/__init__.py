"""Reading the exported tables, writing exports and fitted parameters."""

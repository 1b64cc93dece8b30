"""barline: Spark DataFrame operators for market panels, disclosures and headlines."""

"""Episode analytics on Spark: operators over episodic, multi-view data as DataFrame functions."""

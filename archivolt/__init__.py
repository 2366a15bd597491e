"""archivolt: a PySpark-native engine for identity resolution over file names,
evidence merging, snapshot reconciliation and planning."""

"""motifspark: conditional sequence-motif models, proteome scans and motif consolidation as Spark jobs."""

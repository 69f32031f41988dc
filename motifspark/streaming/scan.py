"""The scan on a stream of proteins. Windows, rules and scores are per row, so no state is kept."""

from motifspark.operators import scan


def scored_windows(proteins, model, rules=None):
    """Candidate windows with conditional scores; works on batch and streaming input alike."""
    return model.score(scan.candidate_windows(proteins, rules))


def best_hits_per_batch(proteins, model, path, checkpoint, k=3):
    """Best motifs of each protein as it arrives. A protein is one row, so its ranks are final within its batch."""
    def write(batch, number):
        hits = scan.best_hits(scored_windows(batch, model), k)
        hits.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return proteins.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

"""Distribution functions and small dense algebra on the driver or inside Arrow batches; numpy and math only."""

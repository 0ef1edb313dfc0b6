"""Writers for predictions, map features, manifests, planes and logs."""

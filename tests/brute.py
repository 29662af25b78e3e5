"""Single-machine restatement of the scoring rules, for comparison in tests."""

import numpy as np

from flowlake import schema


def feature_matrix(frame):
    dur, pk, by = (np.maximum(frame[c].to_numpy(float), lo)
                   for c, lo in (("duration_sec", 1e-3), ("packets", 1.0), ("bytes", 1.0)))
    port, proto = frame["dst_port"].to_numpy(), frame["protocol"].to_numpy()
    unit = lambda c: np.clip(frame[c].to_numpy(float), 0, 1)
    pos = lambda c: np.maximum(frame[c].to_numpy(float), 0)
    columns = [np.log(1 + dur), np.log(1 + pk), np.log(1 + by), by / pk, np.log(1 + by / dur), np.log(1 + pk / dur),
               unit("tcp_syn_ratio"), unit("tcp_ack_ratio"), unit("tcp_fin_ratio"),
               np.log(1 + pos("inter_arrival_mean_ms")), np.log(1 + pos("inter_arrival_std_ms")),
               pos("failed_connections"), frame["direction"] == "inbound",
               proto == "TCP", proto == "UDP", proto == "ICMP", ~np.isin(proto, ["TCP", "UDP", "ICMP"]),
               np.isin(port, schema.WEB_PORTS), np.isin(port, schema.ADMIN_PORTS),
               ~np.isin(port, list(schema.SERVICE_PORTS))]
    return np.column_stack([np.asarray(c, float) for c in columns])


def contexts(frame):
    def band(port):
        return schema.SERVICE_PORTS.get(port) or (
            "system-other" if port < 1024 else "registered" if port < 10000 else "dynamic")
    return np.array([f"{p}|{d}|{band(q)}" for p, d, q in
                     zip(frame["protocol"], frame["direction"], frame["dst_port"])])


class Brute:
    """Fit on one frame, score another."""

    def __init__(self, frame, contamination=0.08, rank=4):
        x = feature_matrix(frame)
        self.contamination = contamination
        self.med = np.median(x, axis=0)
        mad = np.median(np.abs(x - self.med), axis=0)
        self.mad = np.where(mad == 0, 1e-6, mad)
        z = (x - self.med) / self.mad
        self.mean = z.mean(axis=0)
        self.directions = np.linalg.svd(z - self.mean, full_matrices=False)[2][:min(rank, len(x))]
        keys, counts = np.unique(contexts(frame), return_counts=True)
        self.frequency = dict(zip(keys, counts / len(frame)))
        self.threshold = self.decide(frame, self.scores(frame))

    def parts(self, frame):
        z = (feature_matrix(frame) - self.med) / self.mad
        c = np.clip(z - self.mean, -12, 12)
        rest = c - c @ self.directions.T @ self.directions
        rarity = -np.log([self.frequency.get(k, 1e-4) for k in contexts(frame)])
        return np.sqrt((c ** 2).mean(axis=1)), np.sqrt((rest ** 2).mean(axis=1)), rarity

    def scores(self, frame):
        distance, rest, rarity = self.parts(frame)
        return 1.6 * distance + 1.2 * rest + 0.85 * rarity

    def decide(self, frame, scores, floor=None):
        options = [np.quantile(scores, 1 - self.contamination)] + ([floor] if floor is not None else [])
        normal = scores[frame["label"].isin(["normal", "benign", "0"]).to_numpy()]
        if len(normal):
            mid = np.median(normal)
            options += [np.quantile(normal, 0.995), mid + max(3.5 * np.median(np.abs(normal - mid)), 1.0)]
        return max(options)


def adaptive(frame, size, memory, contamination=0.08):
    """Scores, flags and relearn decisions batch by batch over a time-sorted frame."""
    def benign(part):
        normal = part[part["label"] == "normal"]
        return normal

    warm = frame.iloc[:size]
    held = benign(warm) if len(benign(warm)) >= 250 else warm
    model, result, log = Brute(held, contamination), [], []
    held = held.tail(memory)
    for number, start in enumerate(range(0, len(frame), size), start=1):
        batch = frame.iloc[start:start + size]
        scores = model.scores(batch)
        limit = model.decide(batch, scores, model.threshold)
        result.append((batch["flow_id"].to_numpy(), scores, scores >= limit))
        status = "warmup"
        if number > 1:
            part = batch.assign(anomaly_score=scores)
            chosen = benign(part)
            if 0 < len(chosen) < 250:
                extra = part[part["label"].isin(["normal", "unknown"])].nsmallest(250 - len(chosen), "anomaly_score")
                chosen = part.loc[chosen.index.union(extra.index)]
            status = "skipped" if len(chosen) < max(100, size // 20) else "updated"
            if status == "updated":
                held = __import__("pandas").concat([held, chosen]).tail(memory)
                model = Brute(held, contamination)
        log.append((number, limit, status))
    return result, log

"""The testbed's call files grow as its patients do."""

from strandline.plans import loads
from strandline.plans.testbed import dataset
from strandline.sources import vcf
from strandline.sources.scratch import folder


def test_call_files_are_of_few_patients(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(loads, "PER_FILE", 8)
    ds = dataset(spark, sf_dir)
    files = vcf.parse_index(loads._calls(ds, folder(spark, "vcf")))
    carriers = {r[0] for r in ds.genotypes.select("patient_num").distinct().collect()}
    assert sorted(p for f in files for p in f.patients) == sorted(carriers)
    assert len(files) > 8 and max(len(f.samples) for f in files) < 40
    back = vcf.read_vcf(spark, files)
    assert back.variants.count() == ds.variants.count() and back.genotypes.count() == ds.genotypes.count()

"""Declared schemas; nothing is inferred."""

CURVE_ROWS = "SID string, DOI string, composition string, sample_id string, figure_id string, figure_name string, prop_x string, prop_y string, unit_x string, unit_y string, x string, y string, created_at string, updated_at string, project_names string, comments string"
PAPERS = "SID string, DOI string, URL string, issued string, author string, title string"
REGISTRY = "paper_id string, figure_id string, image_path string, panel_label string, x_range array<double>, y_range array<double>, status string, verified_at string, evidence string, x_scale string, y_scale string, license_id string, excluded_reason string"
RESULT = "model_id string, model_name string, status string, note string, dataset_version string, run_at string, n_figures long, mean_summary_score double, per_figure array<struct<figure_id:string,summary_score:double,match_rate:double,mean_curve_distance:double,mean_coverage_ratio:double,error:string>>"
MANIFEST_PAPERS = "paper_id string, doi string, license_id string, n_figures long, n_curves long, n_extracted_images long, pdf_status string"
MANIFEST_FIGURES = "figure_id string, paper_id string, figure_reference string, split string"
MANIFEST_CURVES = "curve_id string, figure_id string, series_label string, n_points long, license string"
WORKS = "results array<struct<doi:string,open_access:struct<is_oa:boolean,oa_status:string>,primary_location:struct<license:string,pdf_url:string>,best_oa_location:struct<license:string,pdf_url:string>,locations:array<struct<license:string>>>>"
